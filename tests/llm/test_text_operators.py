"""Words, near copies, benchmark passages, token files, toxicity and language against plain versions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymart.llm import common, contamination, grammar, language, near_dedup, queries, token_files, toxicity
from tallymart.session import scratch_dir

DOCS = "doc_id long, text string, lang string, source string, n_words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(1)
WORDS = ["".join(RNG.choice(list("abcdefgho"), 5)) for _ in range(400)]


def text_of(n: int, seed: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, single, repeated, very long and mixed texts."""
    long = text_of(30_000, 5)
    return [None, "", " \t\n", "one", "ONE", "a b", "a b a b a b", "naïve Ünïcode x　y  z", "#!? <|endoftext|> #", long, long + " more", "x" * 5000]


def frame(spark, texts, first: int = 1):
    rows = [(first + i, t, "en", None if i % 3 else "s", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_words_are_split_at_six_bytes_only():
    texts = ["A b\x0bc\x0c d\r\ne", "", "x", "y Z \x1f", "\x85 é"]
    got = common.coded_words(pa.array([t.encode() for t in texts], pa.binary()), common.LOWER)
    words = got.distinct.to_pylist()
    for i, t in enumerate(texts):
        expected = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        assert [words[c].decode() for c in got.codes[got.starts[i] : got.starts[i + 1]]] == expected


def near_groups(texts: dict[int, str | None]) -> dict[int, int]:
    """Components by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set(zip(w, w[1:], strict=False)) or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def edited(text: str, changes: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    words = text.split()
    for at in rng.integers(0, len(words), changes):
        words[at] = f"w{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_duplicates_equal_all_pairs(spark):
    base = text_of(120, 2)
    chain = [edited(base, k, k) for k in range(1, 14)]
    star = [edited(text_of(200, 3), 7, 100 + k) for k in range(60)]  # many pairs near the limit, on both sides
    texts = odd_texts()[:9] + [base, base.upper(), base, *chain, *star] + [text_of(n, n) for n in range(3, 40)]
    df = frame(spark, texts)
    found = near_dedup.near_duplicates(df)
    got = {r.doc_id: r for r in found.collect()}
    expected = near_groups({i + 1: t for i, t in enumerate(texts)})
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (i == expected[i]) for i, r in got.items())
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_near_duplicates_of_short_texts_equal_all_pairs(spark):
    texts = []
    for k in range(200):  # one word fewer: 4 of 5, 5 of 6 and 8 of 9 shingles
        words = text_of(6 + (0, 0, 1, 4)[k % 4], 1000 + k).split()
        texts += [" ".join(words), " ".join(words[:-1])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == near_groups({i + 1: t for i, t in enumerate(texts)})


def test_cells_link_all_near_pairs_of_short_texts():
    sets = [s for k in range(200) for whole in [np.unique(np.random.default_rng(k).integers(0, 2**64, 5, dtype=np.uint64))] for s in (whole, whole[:-1])]
    n = len(sets)
    rows = pa.table({
        "rep": np.arange(n), "component": np.arange(n), "n_shingles": [len(s) for s in sets], "block": np.zeros(n, np.int64),
        "registers": pa.array([r.tobytes() for r in near_dedup.registers(sets)], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    found = near_dedup._rest(0.8)((pa.scalar(0), pa.scalar(0)), rows)
    assert sorted(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True)) == [(2 * k, 2 * k + 1) for k in range(200)]


def test_ids_with_several_texts_lose_no_text_and_share_a_component(spark):
    rows = [(3, "a b c"), (5, "a b c"), (5, "x y z w"), (6, "x y z w"), (8, "p q"), (8, "r s"), (8, " "), (9, "r s"), (2, "r s t"), (2, None), (None, "r s")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.near_duplicates(df).collect())
    assert found == [(0, 1, 0), (2, 0, 2), (2, 2, 2), (3, 2, 3), (5, 2, 3), (5, 3, 3), (6, 3, 3), (8, 0, 8), (8, 1, 8), (8, 1, 8), (9, 1, 8)]
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns
    gone = {(5, "a b c"), (6, "x y z w"), (9, "r s")}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r for r in rows if r not in gone), key=str)


def test_no_text_is_lost_where_ids_repeat_at_random(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"v{i}w{k}" for k in range(30)) for i in range(12)]
    texts += [t.replace("w7", "changed") for t in texts[:6]]
    rows = [(int(rng.integers(14)), texts[rng.integers(len(texts))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {t: set(zip(t.split(), t.split()[1:])) for t in texts}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    # By documents: everything that an id's texts are linked with.
    label = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in rows:
            for j, b in rows:
                if near(a, b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == set(label.items())
    kept = [(r.doc_id, r.text) for r in near_dedup.deduplicated(df).collect()]
    for i, a in rows:
        least = min(j for j, b in rows if near(a, b))
        assert (i, a) in kept if i == least else (i, a) not in kept


def test_near_duplicates_with_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c", "en", "s", ""), (5, "a b c", "en", "s", ""), (5, "a b c", "en", "s", ""), (7, "a b c", "en", "s", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_registers_estimate_the_similarity():
    a = [np.sort(RNG.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(40)]
    b = [np.sort(np.concatenate((x[: 2700], RNG.integers(0, 2**63, 300).astype(np.uint64)))) for x in a]
    n = np.full(40, 3000)
    guess = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b), n, n)
    assert abs(guess.mean() - 2700 / 3300) < 0.03
    apart = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b[::-1]), n, n)
    assert abs(apart.mean()) < 0.02


def windows_found(texts: dict, items: list[tuple[int, str]], size: int = 13) -> dict:
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held: dict[tuple, set[str]] = {}
    for name, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1)) if w else []:
            held.setdefault(tuple(w[k : k + size]), set()).add(str(name))
    out = {}
    for i, t in texts.items():
        w = pattern.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit.update(range(k, k + n))
                    names |= held[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


ITEMS = [(1, text_of(40, 11)), (2, text_of(20, 12) + " " + text_of(15, 11)), (3, "short item, here"), (4, "short"), (5, ""), (6, None), (7, "here here here"), (8, text_of(40, 11))]


@pytest.mark.parametrize("words_each", [contamination.WORDS_PER_AUTOMATON, 20])
def test_contamination_equals_plain_search(spark, monkeypatch, words_each):
    monkeypatch.setattr(contamination.automata, "__defaults__", (words_each,))
    passage = ITEMS[0][1].split()
    texts = odd_texts() + [
        text_of(100, 20) + " " + " ".join(passage[5:30]).upper() + "; " + text_of(200, 21),
        " ".join(passage[:12]), " ".join(passage[:13]), "here here here here", "Short Item -- here!", text_of(3000, 22) + " " + ITEMS[1][1],
    ]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = frame(spark, texts)
    expected = windows_found({i + 1: t for i, t in enumerate(texts)}, ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in contamination.report(df, benchmark).collect()}
    assert got == expected
    clean = contamination.decontaminated(df, benchmark)
    assert clean.schema == df.schema
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, e in expected.items() if not e[3]]


def test_spans_are_cut_out_of_texts(spark):
    passage = ITEMS[0][1].split()
    text = "Before, " + " ".join(passage[3:23]) + "! after"
    benchmark = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    df = frame(spark, [text, None, "plain"])
    got = contamination.without_spans(df, benchmark)
    assert got.columns == df.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["Before, ! after", None, "plain"]


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = frame(spark, ["a b", None])
    assert [r.contaminated for r in contamination.report(df, none).collect()] == [False, False]
    assert contamination.report(df.where("false"), none).count() == 0


def test_grammar_round_trip_and_ranges():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 300, 50)
    docs = [np.concatenate([phrase[: rng.integers(1, 50)] for _ in range(rng.integers(1, 60))] + [[2]]) for _ in range(30)] + [np.array([2])]
    docs += [np.full(1000, 7)]
    ids, counts = np.concatenate(docs).astype(np.uint16), np.array([len(d) for d in docs])
    held = grammar.unpacked(grammar.packed(grammar.compress(ids, counts, np.arange(32), np.zeros(32, bool), 300)))
    decoder = grammar.Decoder(held)
    assert (decoder.expand(held.symbols) == ids).all() and len(held.symbols) < len(ids) / 3
    assert len(held.left) and (held.length >= 2).all()
    for k, d in enumerate(docs):
        assert (decoder.document(k) == d).all()
        a, b = sorted(rng.integers(0, len(d) + 1, 2))
        assert (decoder.document(k, a, b) == d[a:b]).all()
    with pytest.raises(ValueError):
        grammar.unpacked(b"something else, of another kind")


def test_pairs_are_replaced_until_none_is_frequent():
    rng = np.random.default_rng(4)
    phrase = rng.permutation(1000)
    docs = [np.concatenate((rng.integers(0, 1000, 3), phrase, [2])) for _ in range(64)]
    ids, counts = np.concatenate(docs).astype(np.uint16), np.array([len(d) for d in docs])
    held = grammar.unpacked(grammar.packed(grammar.compress(ids, counts, np.arange(64), np.zeros(64, bool), 50_257)))
    assert (grammar.Decoder(held).expand(held.symbols) == ids).all()
    assert held.doc_symbols.max() <= 8 and held.length.max() >= 900
    own = np.split(held.symbols, np.cumsum(held.doc_symbols)[:-1])
    pairs = np.concatenate([np.stack((s[:-1], s[1:])) for s in own], axis=1)
    assert np.unique(pairs, axis=1, return_counts=True)[1].max() < grammar.LEAST_COUNT


def test_wide_ids_use_four_bytes():
    ids = np.tile(np.array([70_000, 90_001, 5]), 200).astype(np.uint32)
    held = grammar.unpacked(grammar.packed(grammar.compress(ids, np.array([len(ids)]), np.zeros(1), np.zeros(1, bool), 100_000)))
    assert (grammar.Decoder(held).expand(held.symbols) == ids).all()


def test_token_files_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = odd_texts() + [text_of(n, n) + "   é \n\n  it's we'll  1234 " for n in (5, 50, 500)]
    df = frame(spark, texts[::-1], first=-3)
    path = scratch_dir(spark, "test-tokens")
    token_files.write_tokens(df, path, queries.tokenizer_path(), block_tokens=5000)
    start = 0
    got = token_files.read_digests(spark, path).orderBy("start").collect()
    whole = {r.doc_id: (r.start, r.ids) for r in token_files.read_tokens(spark, path).collect()}
    for row, (doc_id, text) in zip(got, enumerate(texts[::-1], start=-3), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc)
        assert whole[doc_id] == (start, ids)
        start += len(ids)
    assert token_files.read_tokens(spark, path, [0]).count() == 1


def test_token_files_of_null_and_repeated_ids_and_of_nothing(spark):
    rows = [(None, "b", "", "", ""), (3, "a", "", "", ""), (3, "a", "", "", "")]
    path = scratch_dir(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame(rows, DOCS), path, queries.tokenizer_path())
    got = token_files.read_digests(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (3, 2, 2), (3, 4, 2)]
    path = scratch_dir(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame([], DOCS), path, queries.tokenizer_path())
    assert token_files.read_digests(spark, path).count() == 0


def held_out(doc_id: int, folds: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_toxicity_finds_words_and_misspellings_in_long_texts(spark):
    rng = np.random.default_rng(9)
    bad = ["scoundrel", "villainous"]
    texts, labels = [], []
    for i in range(900):
        words = list(rng.choice(WORDS, rng.integers(5, 200)))
        if i % 4 == 0:
            words.insert(rng.integers(len(words)), bad[rng.integers(2)])
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    docs = frame(spark, texts, first=0)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert all(r.held_out == held_out(i, 3, 1) for i, r in got.items())
    out = [(labels[i][1], r.predicted) for i, r in got.items() if r.held_out]
    assert np.mean([a == b for a, b in out]) > 0.97
    new = frame(spark, ["the " + text_of(2000, 31) + " scoundrels", text_of(2000, 32), *odd_texts()])
    scored = [r.predicted for r in toxicity.toxicity(new, model).orderBy("doc_id").collect()]
    assert scored[:2] == [1, 0] and set(scored[2:6]) == {0}
    kept = toxicity.without_toxic(new, model)
    assert kept.schema == new.schema and kept.where("doc_id = 1").isEmpty() and not kept.where("doc_id = 2").isEmpty()
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, marks)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b", None])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.toxicity(docs, model).collect()] == [0, 0]
    assert toxicity.toxicity(docs.where("false"), model).count() == 0


def test_language_held_out_accuracy_and_odd_texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(300)] for lang, letters in (("xx", "abcdeghi"), ("yy", "éaoubcdg"), ("zz", "klmnopqi"))}
    rows = []
    for i in range(600):
        lang = list(vocabulary)[i % 3]
        rows.append((i, " ".join(rng.choice(vocabulary[lang], rng.integers(4, 60))), lang if i % 10 else None, "s", "clash"))
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    assert model.languages == ["xx", "yy", "zz"] and (model.weights == 0).mean() > 0.3
    got = {r.doc_id: r for r in language.languages(docs, model).collect()}
    assert all(r.held_out == held_out(i, 5, 0) and 0 <= r.score <= 1 for i, r in got.items())
    out = [r.lang_pred == list(vocabulary)[i % 3] for i, r in got.items() if r.held_out]
    assert np.mean(out) > 0.97
    odd = [r.lang_pred for r in language.languages(frame(spark, [None, "", "123 ?!", "abc"]), model).orderBy("doc_id").collect()]
    assert odd[:3] == ["und"] * 3 and odd[3] in vocabulary
    plain = language.inverse_frequencies(docs.select(F.col("text").cast("binary").alias("text")))
    assert plain.min() >= 1 and len(plain) == language.BUCKETS


def test_language_of_nothing_learnt(spark):
    docs = frame(spark, ["a b", None]).withColumn("lang", F.lit(None).cast("string"))
    model = language.fit(docs)
    assert [r.lang_pred for r in language.languages(docs, model).collect()] == ["und", "und"]
