"""The pipeline over tables with null and repeated ids, clashing columns, no labels, no benchmark, and no rows."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, copies int, mark string, component_id long, size string"
LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id string, text string"


def tables(spark, folder, documents, labels=(), benchmark=()):
    for name, rows, kind in (("documents", documents, DOCUMENTS), ("labels", labels, LABELS), ("benchmark", benchmark, BENCHMARK)):
        spark.createDataFrame(list(rows), kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def document(doc_id, text, source="s"):
    return (doc_id, text, "en", source, 1, "r", 2, "m", 3, "z")


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"odd-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out[name] = docs
    return out


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    prose = [" ".join(f"word{i}x{k}" for k in range(60)) for i in range(30)]
    item = " ".join(f"item{k}" for k in range(20))
    rows = [document(i, t, f"s{i % 3}") for i, t in enumerate(prose)]
    rows += [document(100, prose[4]), document(101, None), document(102, ""), document(103, " \t"), document(None, prose[5] + " more", None), document(None, "no id")]
    rows += [document(7, "another text of the same id entirely"), document(8, prose[8], "s2"), document(104, item), document(105, "x" * 100_000, None)]
    rows += [document(200 + i, f"you awful insult{i % 3} person {i}", "t") for i in range(60)]
    labels = [(200 + i, 0, int(i % 2 == 0)) for i in range(60)] + [(i, 1, 0) for i in range(30)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    out = stages(spark, tables(spark, tmp_path, rows, labels, [("a", item), ("b", None), ("c", "")]))
    kept = {name: Counter((r.doc_id, r.text) for r in docs.collect()) for name, docs in out.items() if name != "token_files"}
    assert (100, prose[4]) not in kept["near_dedup"] and (7, "another text of the same id entirely") in kept["near_dedup"]
    assert (None, "no id") in kept["near_dedup"] and (104, item) not in kept["decontamination"] and (102, "") in kept["decontamination"]
    assert all(kept["decontamination"][k] * 2 >= n for k, n in kept["mixing"].items())
    tokens = out["token_files"].collect()
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in out["mixing"].collect())
    starts = sorted((r.start, r.n_tokens) for r in tokens)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("documents", [[], [document(1, "a single row")]])
def test_empty_tables_and_a_single_row(spark, tmp_path, documents):
    out = stages(spark, tables(spark, tmp_path, documents))
    assert out["decontamination"].count() == len(documents) and out["token_files"].count() == out["mixing"].count()
