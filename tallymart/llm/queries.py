"""Named queries of the operators; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import (
    contamination,
    disclosure,
    filter_audit,
    hard_negatives,
    language,
    mixing,
    near_dedup,
    nearest,
    sharding,
    token_files,
    tool_calls,
    toxicity,
    url_templates,
)
from tallymart.llm.common import on_executors
from tallymart.llm.oracle import ORACLE
from tallymart.session import scratch_dir

__all__ = ["ORACLE", "QUERIES"]

RULES = [
    url_templates.Rule("net", "/", "block"),
    url_templates.Rule("example.net", "/en/", "allow"),
    url_templates.Rule("example.com", "/de/", "block"),
    url_templates.Rule("org", "/fr/", "allow"),
]

#: name, parameter, JSON type, required
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("lookup", "key", "integer", True),
    ("lookup", "exact", "boolean", False),
    ("lookup", "context", "string", False),
    ("translate", "text", "string", True),
    ("translate", "options", "object", False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every twentieth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from grammar-compressed files."""
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_digests(spark, path)


def op3_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; pages are labelled by the quality of the label with their id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_templates.judged(table(spark, sf_dir, "pages"), labels, RULES)


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations.

    Every assistant turn stands for one call, whose tool follows from its text and whose arguments hold its whole text
    (some lack a parameter, have a wrong type or an unknown one), and every user turn after the first for the result of
    the call before it. Where no assistant turn is before it, the result has no call.
    Three calls in four come after the conversation's previous one.
    """
    name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    text = F.coalesce("text", F.lit(""))
    pick = F.crc32(text.cast("binary"))
    quoted = F.to_json(F.struct(text.alias("query"))).substr(F.lit(2), F.lit(1 << 30))
    body = quoted.substr(F.lit(9), F.length(quoted) - 9)  # the quoted text alone
    number = F.length(text)
    arguments = (
        F.when(pick % 3 == 0, F.concat(F.lit('{ "query": '), body, F.when(pick % 5 != 0, F.concat(F.lit(', "limit": '), number)).otherwise(F.lit("")), F.lit("}")))
        .when(pick % 3 == 1, F.concat(F.lit('{"key": '), F.when(pick % 7 != 0, F.concat(pick.cast("string"), F.lit(', "context": '), body)).otherwise(body), F.lit(', "exact": true}')))
        .otherwise(F.concat(F.lit('{"text": '), body, F.when(pick % 11 == 0, F.lit(', "tone": 1.5')).otherwise(F.lit("")), F.lit(', "options": {"to": "en", "at": [1, 2]}}')))
    )
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("translate")), (pick % 3 + 1).cast("int"))
    before = F.when((pick % 4 != 0) & (F.col("turn") >= 2), F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", name.alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"), before.alias("after")
    )
    answered = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1)
    results = turns.where("role = 'user' and turn > 0").select("conv_id", answered.alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every conversation, linked, ordered, checked and written as canonical JSON, and every result without a call."""
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    tools = spark.createDataFrame(TOOLS, "name string, parameter string, type string, required boolean")
    found = tool_calls.linked(calls, results, tools, orphans=True)
    return found.withColumn("errors", F.array_join("errors", "; "))


def op6_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.fit(docs))


def op7_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and kept flag of every document at a Jaccard similarity of 0.8 on two-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; 40 shards of equal bytes."""
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    found = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text", checksum), 40)
    return found.select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    found = mixing.mixed(docs, F.col("words"))
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove in every order, for each language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives from four fifths of each positive's score up to it, for every hundredth vector; every seventh has a shifted label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the words that disclose it."""
    return disclosure.found_spans(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: on_executors(f)
    for f in (
        op1_rotated_codes,
        op2_repair_tokens,
        op3_path_templates,
        op4_suffix_automaton,
        op5_tool_calls,
        op6_ftrl_language,
        op7_hyperminhash_dedup,
        op8_histogram_shards,
        op9_entropy_mix,
        op10_subword_toxicity,
        op11_filter_audit,
        op12_hard_negatives,
        op13_disclosure,
    )
}
