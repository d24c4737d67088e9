"""From raw documents to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes every stage's result
to the shared folder and reads it again. A stage's result is deleted once the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymart.llm import contamination, mixing, near_dedup, queries, token_files, toxicity
from tallymart.llm.common import dropped, on_executors, written
from tallymart.session import scratch_dir


@on_executors
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7 for toxicity."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


@on_executors
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return near_dedup.deduplicated(docs)


@on_executors
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words less than a twentieth stand in benchmark windows."""
    return contamination.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


@on_executors
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.repeated(docs)


@on_executors
def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows; returns doc_id, start, n_tokens and ids_crc32 as read back from them."""
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(docs, path, queries.tokenizer_path())
    return token_files.read_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: The classifier, the grammar and the rounding have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return docs
