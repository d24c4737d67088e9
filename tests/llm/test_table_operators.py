"""Vectors, shards, mixes, urls, tool calls and the pipeline against plain versions."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import graph, mixing, near_dedup, nearest, queries, sharding, tool_calls, url_templates
from tallymart.llm.graph import components

SF = "/root/testdata/sf0.001"


def plain_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v) for i, v in good if len(v) == len(good[0][1])]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted(((-float(v @ w), i) for i, w in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_nearest_with_odd_vectors_ties_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "VECTORS_PER_BLOCK", 100)
    monkeypatch.setattr(nearest, "QUERIES_PER_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # copies of a query's vector
    rows += [(480, None), (500, [0.0] * 8), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (580, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    expected = plain_nearest([(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows], 20)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(expected)
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in expected[q]], abs=1e-12)
        assert [i for i, _ in found] == [i for i, _ in expected[q]]
    assert nearest.nearest(df.where("false"), F.lit(True)).count() == 0
    assert nearest.nearest(df.where("vec_id in (20, 1)"), F.col("vec_id") == 20).count() == 1


def test_repeated_rows_are_candidates_of_their_own(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(25, 70))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] * 2 + [(20, rng.normal(size=70).tolist())] + [(7, vectors[7].tolist())] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    queries_ = {(i, tuple(v)) for i, v in rows if i % 20 == 0}
    assert len(queries_) == 3 and len(found) == 60
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    expected = defaultdict(list)
    for i, v in queries_:
        scored = sorted((-round(float(np.dot(v, w)), 9), j) for j, w in rows if j != i)[:20]
        expected[i] += [(n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in expected.items()}


def test_codes_are_packed_bits_and_bounds_hold():
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(3000, 100)), rng.normal(size=(50, 100))
    turn = nearest.rotation(100)
    codes, planes = nearest.Codes(vectors, turn), nearest.Planes(asked, turn)
    assert codes.packed.shape == (3000, 2) and codes.packed.dtype == np.uint64 and turn.shape == (100, 128)
    guess, bound = planes.estimates(codes, 0, 3000)
    miss = np.abs(guess - asked @ vectors.T)
    assert (miss <= bound).mean() > 0.98 and bound.mean() < 0.5 * np.linalg.norm(vectors, axis=1).mean() * np.linalg.norm(asked, axis=1).mean()


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    expected = plain_nearest(rows, 20)
    got = defaultdict(set)
    for r in queries.op1_rotated_codes(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & {i for i, _ in best}) / len(best) for q, best in expected.items()]
    assert np.mean(hits) >= 0.99


DOCS = "doc_id long, text string, source string, size string"


def documents(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(rng.integers(1, 400)), f"s{rng.integers(5)}" if i % 3 else "hot", "clash") for i in range(n)]
    rows += [(n + i, "the same text", "hot", "clash") for i in range(n // 2)]
    rows += [(-1, None, None, None), (-2, "", "", "x"), (None, "no id", "s1", "x"), (-3, "x" * 40_000, "s2", "")]
    return spark.createDataFrame(rows, DOCS)


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    df = documents(spark)
    for shards, range_bytes in ((7, 1 << 30), (3, 5000)):
        rows = sharding.sharded(df, shards, range_bytes).collect()
        assert len(rows) == df.count()
        held, sums = defaultdict(list), defaultdict(int)
        for r in rows:
            assert r["size"] == len((r.row.text or "").encode()) + 16 and r.row["size"] in ("clash", None, "x", "")
            held[r.shard].append(r.slot)
            sums[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in held.values()) and set(held) <= set(range(shards))
        target = sum(sums.values()) / shards
        assert all(abs(sums[s] - target) <= 40_016 + 0.01 * target for s in range(shards))
    assert sharding.sharded(df.where("false"), 4).count() == 0
    same = [(r.row.doc_id, r.shard, r.slot) for r in sharding.sharded(df, 7).collect()]
    assert sorted(same, key=str) == sorted(((r.row.doc_id, r.shard, r.slot) for r in sharding.sharded(df, 7).collect()), key=str)


def test_repeated_rows_share_a_shard(spark):
    df = spark.createDataFrame([(1, "a" * 50, "s", "")] * 30 + [(2, "b" * 50, "s", "")] * 30, DOCS)
    rows = sharding.sharded(df, 2).collect()
    assert sorted(r.slot for r in rows if r.shard == rows[0].shard)[0] == 0
    assert len({(r.row.doc_id, r.shard) for r in rows}) == 2


def test_targets_follow_the_weights_and_their_limit():
    sizes = [(None, 10), ("a", 100), ("b", 1000), ("c", 1000), ("d", 50), ("z", 0)]
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * 2160)
    assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes)
    assert got["a"] == 200 and got["d"] == 100 and got["z"] == 0 and got[None] == 20
    assert got["b"] / got["c"] == pytest.approx(2 / 1) or got["b"] == 2000


def test_mix_comes_near_its_targets_and_repeats(spark):
    df = documents(spark)
    found = mixing.mixed(df, mixing.n_words(F.col("text"))).collect()
    assert len(found) == df.count()
    totals = defaultdict(lambda: [0, 0, 0.0])
    for r in found:
        words = len((r.row.text or "").split())
        assert r["size"] == words and r.copies in (0, 1, 2)
        t = totals[r.row.source]
        t[0] += words
        t[1] += words * r.copies
        t[2] = r.target
    wanted = mixing.targets([(s, t[0]) for s, t in totals.items()])
    for s, (size, taken, target) in totals.items():
        assert target == pytest.approx(wanted[s])
        assert abs(taken - target) <= max(2, 0.01 * target)
    again = {(r.row.doc_id, r.copies) for r in mixing.mixed(df, mixing.n_words(F.col("text"))).collect()}
    assert again == {(r.row.doc_id, r.copies) for r in found}
    rows = mixing.repeated(df)
    assert rows.schema == df.schema and rows.count() == sum(r.copies for r in found)
    assert mixing.mixed(df.where("false"), mixing.n_words(F.col("text"))).count() == 0


def test_mix_of_sources_of_one_size_or_without_words(spark):
    df = spark.createDataFrame([(i, "a b", "one" if i % 2 else "two", "") for i in range(40)] + [(99, " ", "none", "")], DOCS)
    rows = mixing.mixed(df, mixing.n_words(F.col("text"))).collect()
    assert sum(r["size"] * r.copies for r in rows) == pytest.approx(1.5 * 80, abs=2)
    assert {r.target for r in rows if r.row.source == "none"} == {0.0}


def dense_dual(sizes, share):
    """The dual of one source by bisection, and the rates that it gives."""
    x = np.array(sizes) / np.mean(sizes)
    low, high = -1e6, 1e6
    with np.errstate(over="ignore"):
        for _ in range(200):
            b = (low + high) / 2
            rate = 2 / (1 + np.exp(-b * x))
            low, high = (b, high) if (x * rate).sum() < share * x.sum() else (low, b)
    return b, rate


@pytest.mark.parametrize("share", [0.02, 0.4, 1.0, 1.5, 1.97])
def test_rates_are_tilted_and_solve_the_dual(spark, share):
    rng = np.random.default_rng(int(share * 100))
    sizes = np.maximum(1, (rng.pareto(1.2, 400) * 50).astype(int))
    histogram = spark.createDataFrame([(0, int(n), 1) for n in sizes] + [(1, 7, 50)], "sid int, size long, n long")
    sources = spark.createDataFrame([(0, float(sizes.mean()), share), (1, 7.0, share)], "sid int, mean double, share double")
    found = {r.sid: r.b for r in mixing.duals(histogram, sources).collect()}
    b, rate = dense_dual(sizes, share)
    assert found[0] == pytest.approx(b, rel=1e-5, abs=1e-6)
    x = sizes / sizes.mean()
    gradient = (x * (share - 2 / (1 + np.exp(-found[0] * x)))).sum()
    assert abs(gradient) <= 1e-8 * x.sum()
    assert 2 / (1 + np.exp(-found[1])) == pytest.approx(share)  # equal sizes: nothing to tilt
    if share != 1.0:
        assert np.ptp(rate) > 0.1


def test_a_mix_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="converged"):
        mixing.mixed(documents(spark, 60), mixing.n_words(F.col("text")))


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "a b c", "s", "x")] * 7 + [(2, "a b c", "s", "x")] * 2 + [(i, "w " * i, "t", None) for i in range(40)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, DOCS)
    copies = defaultdict(int)
    for r in mixing.mixed(df, mixing.n_words(F.col("text"))).collect():
        copies[tuple(r.row)[0], r.row.source] += r.copies
    out = mixing.repeated(df)
    assert out.schema == df.schema
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id, r.source] += 1
    assert sum(times.values()) == pytest.approx(sum(copies.values()), abs=3) and set(times) <= {(r[0], r[2]) for r in rows}
    assert 0 < times[1, "s"] <= 14 and times[None, None] == 0  # a source without words is not taken
    assert mixing.repeated(df.where("false")).count() == 0


def test_mix_of_many_sources_and_identical_rows(spark):
    rows = [(i, "w " * (1 + i % 50), f"source{i % 300}", "") for i in range(3000)] + [(-1, "a b c", "same", "x")] * 500
    found = mixing.mixed(spark.createDataFrame(rows, DOCS), mixing.n_words(F.col("text"))).collect()
    totals = defaultdict(lambda: [0, 0.0, 0])
    for r in found:
        t = totals[r.row.source]
        t[0] += r["size"] * r.copies
        t[1], t[2] = r.target, max(t[2], r["size"])
    assert len(found) == 3500 and all(abs(taken - target) <= longest for taken, target, longest in totals.values())
    assert totals["same"][0] == pytest.approx(totals["same"][1], abs=3)


URLS = [
    None, "", "no scheme/x", "http://A.Example.NET/en/5?x=1#y", "https://example.net/en/7", "http://b.net", "http://b.net/", "ftp://x.org/fr/1", "http://org/fr/",
    "http://notorg/fr/1", "http://m.example.com/de/9#z", "http://m.example.com/en/9", "x://h?/en/", "a://b://c/d", "http://example.com", "http://UP.ÀE.com/a b/ü",
]


def plain_rule(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: r for r in url_templates.judged(pages, labels, queries.RULES).collect()}
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
            rest = rest[end:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (rule.host + rule.path if rule else None)
        assert got[i].verdict == (rule.verdict if rule else "allow")
    assert url_templates.judged(pages.where("false"), labels, queries.RULES).count() == 0


def test_impure_templates_are_blocked_and_numbers_become_wildcards(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, f"http://h.test/{'casino' if bad else 'news'}/{i}/{'a' * 50 if i == 8 else 'view'}?q=1", ""))
        labels.append((i, 1 - bad if i < 300 else None))
    rows += [(1000 + i, f"http://h.test/item{i}x/deep/er/and/more/levels/than/six/{i}", "") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, template string")
    found = {r.page_id: r for r in url_templates.judged(pages, spark.createDataFrame(labels, "page_id long, good int"), []).collect()}
    assert len(found) == 500
    assert all(found[i].verdict == ("block" if i % 2 else "allow") for i in range(400))
    assert found[3].template == "/casino/{number}/view" and found[8].template == "/news/{number}/{long}"
    assert {found[1000 + i].template for i in range(100)} == {"/{any}/deep/er/and/more/levels/{tail}"}


def test_sections_are_told_apart_by_labels_at_any_number_and_depth(spark):
    rows = []
    for host, bad in (("mostly-good.test", 10), ("mostly-bad.test", 90)):
        rows += [(f"http://{host}/section{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}", k < bad) for k in range(100) for i in range(20)]
    for above in ("a/b/c/d/e/f", "a/b/c/d/e/f/g/h/i/j"):
        rows += [(f"http://deep{len(above)}.test/{above}/{kind}/{i}", kind == "casino") for kind in ("casino", "news") for i in range(30)]
    rows += [("http://one.test/a/b/c/d/e/f/g/h/12", k > 0) for k in range(3)]  # one path whose labels differ
    rows += [(f"http://alike.test/a/b/c/d/e/f/g/{i}", False) for i in range(5)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, (_, b) in enumerate(rows)], "page_id long, good int")
    found = {r.page_id: r for r in url_templates.judged(pages, labels, []).collect()}
    assert len(found) == len(rows)
    for i, (url, b) in enumerate(rows):
        if "one.test" in url:
            assert found[i].template == "/a/b/c/d/e/f/g/h/{number}"
        elif "alike.test" in url:
            assert found[i].template == "/a/b/c/d/e/f/{tail}"
        else:
            assert found[i].verdict == ("block" if b else "allow"), url


def test_tool_calls_are_linked_ordered_checked_and_canonical(spark):
    calls = [
        (1, "a", 5, "search", '{ "limit": 3,\n "query": "x" }', "b"), (1, "b", 9, "lookup", '{"key": 7}', None), (1, "c", 2, "nope", "{}", "a"),
        (1, "d", 1, "search", '{"query": 5, "more": null}', "e"), (1, "e", 2, "lookup", "[1]", "d"), (1, "f", 3, "translate", "{broken", "missing"),
        (1, "b", 10, "lookup", '{"key": 8}', None), (2, "a", 1, "lookup", '{"key": 1.5}', "a"), (2, None, 1, "lookup", "{}", None), (2, "z", 1, None, None, None),
    ]
    calls += [(3, f"k{i}", i, "lookup", '{"key": 1}', f"k{i + 1}" if i < 40 else None) for i in range(41)]  # a chain written backwards
    results = [(1, "a", 6, 'say "hi"\n'), (1, "a", 7, "later"), (1, "b", 10, None), (9, "a", 1, "other"), (1, None, 1, "x")]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    tools = frame(queries.TOOLS, "name string, parameter string, type string, required boolean")
    found = tool_calls.linked(
        frame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string"),
        frame(results, "conv_id long, call_id string, turn long, content string"),
        tools,
    )
    got = {(r.conv_id, r.call_id): r for r in found.collect()}
    assert len(got) == 6 + 2 + 41
    status = {k: (r.status, list(r.errors)) for k, r in got.items() if k[0] != 3}
    assert status[1, "a"] == ("ok", []) and status[1, "b"] == ("ok", [])
    assert status[1, "c"] == ("invalid", ["unknown tool"]) and status[1, "f"] == ("invalid", ["arguments are no object"])
    assert status[1, "d"][0] == status[1, "e"][0] == status[2, "a"][0] == "cyclic"
    assert status[1, "d"][1] == ["missing limit", "type of query", "unknown more"] and status[2, "a"][1] == ["type of key"]
    assert (got[1, "b"].calls, got[1, "a"].results, got[1, "a"].result_turn) == (2, 2, 6)
    places = {k[1]: r.position for k, r in got.items() if k[0] == 1}
    assert places["b"] < places["a"] < places["c"] and sorted(places.values()) == list(range(1, 7))
    assert [got[3, f"k{i}"].position for i in range(41)] == list(range(41, 0, -1))
    parsed = json.loads(got[1, "a"].json)
    assert parsed == {"after": "b", "arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search", "result": 'say "hi"\n'}
    assert got[1, "a"].json == json.dumps(parsed, separators=(",", ":"), sort_keys=True)
    none = frame(calls[:0], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    assert tool_calls.linked(none, frame([], "conv_id long, call_id string, turn long, content string"), tools).count() == 0


def test_calls_hold_whole_texts_and_results_without_a_call_are_kept(spark):
    texts = [f'say "{i}"\\ and\n' + "more words é " * 60 + f"end {i}" for i in range(60)]
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "lost"), (1, 2, "assistant", texts[0]), (1, 3, "user", "found"), (1, 2049, "user", "late")]
    rows += [(2 + i, 0, "assistant", t) for i, t in enumerate(texts)]
    calls, results = queries.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    tools = spark.createDataFrame(queries.TOOLS, "name string, parameter string, type string, required boolean")
    found = tool_calls.linked(calls, results, tools, orphans=True).collect()
    held = {r.conv_id: json.loads(r.json)["arguments"] for r in found if r.calls}
    assert all(texts[c - 2] in held[c].values() for c in range(2, 62)) and len({r.name for r in found if r.calls}) == 3
    got = {r.call_id: (r.status, r.calls, r.results, r.position, list(r.errors), json.loads(r.json)["result"]) for r in found if r.conv_id == 1}
    assert got.pop("c1-2")[1:4] == (1, 1, 1)
    assert got == {"c1-0": ("orphan", 0, 1, 2, [], "lost"), "c1-2048": ("orphan", 0, 1, 3, [], "late")}


@pytest.mark.parametrize("at_once", [graph.EDGES_AT_ONCE, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", at_once)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 160)) and 300 not in got


def test_native_queries_run_no_python(spark):
    for query in (queries.op3_path_templates, queries.op5_tool_calls):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages_one_by_one(spark):
    docs = queries.table(spark, SF, "documents")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == names
        seen[name] = (before, docs)
        if name != "mixing":
            assert docs.subtract(before).isEmpty() and docs.count() <= before.count()
    before, after = seen["near_dedup"]
    assert after.count() == near_dedup.near_duplicates(before).where("kept").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_fold_is_the_checksum_of_the_id(spark):
    from tallymart.llm.subwords import fold

    ids = [0, 7, -5, 10**12]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect()
    assert {r.doc_id: r.f for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 for i in ids}
