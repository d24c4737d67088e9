"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE does the size-dependent work: it coalesces small shuffle partitions, splits skewed
# ones in joins and rebalances, and turns a join into a broadcast only after it has seen
# how large the side really is.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A dimension that is cut thins the sales before their shuffle: a Bloom filter of its keys goes to their scan.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


PARTITION_BYTES = 128 * 1024 * 1024


def settings_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Partition counts for an input size, so that a shuffle partition fits an executor core's memory.

    The count is the upper end: AQE merges what turns out small.
    """
    partitions = max(math.ceil(input_bytes / PARTITION_BYTES), cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
    }


def build_session(app_name: str = "tallymart", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_scratch: str | None = None


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    A session that runs in this process alone, as in tests, gets a folder of its own if the setting is missing. A
    cluster session without it is an error, because executors do not share a local disk.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="tallymart-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        base = _local_scratch
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
