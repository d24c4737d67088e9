"""Appends to database tables over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcWriter:
    """Appends frames; errors are raised to the caller.

    ``connections`` caps the parallel inserts, so that a wide cluster does not flood the
    database. With a run id, rows are stamped: an append is not atomic over tasks, so
    readers take the newest complete run instead of trusting the table as a whole.
    """

    url: str
    properties: dict[str, str]
    connections: int = 16

    def append(self, df: DataFrame, table: str, run_id: int | None = None) -> None:
        rows = df if run_id is None else df.withColumn("run_id", F.lit(run_id).cast("bigint"))
        (
            rows.write.option("numPartitions", str(self.connections)).jdbc(
                url=self.url, table=table, mode="append", properties=self.properties
            )
        )
