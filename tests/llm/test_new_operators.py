"""Filter audit, hard negatives and disclosure against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import differences
from tallymart.llm import disclosure, filter_audit, hard_negatives, queries
from tallymart.llm.common import coded_words

SF = "/root/testdata/sf0.001"
BLANK = r"\x20\x09-\x0D"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    rows, ours, theirs = differences(spark, SF, queries.QUERIES[name], queries.ORACLE[name])
    assert rows and not ours and not theirs


# Filter audit


def plain_audit(docs, labels):
    firsts, marks = {}, defaultdict(lambda: [0, 0])
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(f"[^{BLANK}]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > firsts[text],
        }
        good, toxic = marks[i] if i in marks else (0, 0)
        rows.append((lang or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                failing = [r for r in own if r[1][f]]
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_of(spark, docs, labels):
    frame = spark.createDataFrame(
        [(*d, "clash", 7) for d in docs], "doc_id long, text string, lang string, part string, kept int"
    )
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.audit(frame, marks).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    result = {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in found}
    assert len(result) == len(found)
    return result


def odd_documents():
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in range(150))
    texts = [long, long + " #", long.upper(), "", None, " \t\n", "same same", "Ä" * 50 + "A" * 6, "x" * 300_000, "é z " * 120, "50% | &", "　".join("ab" * 200)]
    docs = [(i, texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for i in range(150)]
    docs += [(7, docs[7][1], "en"), (7, docs[7][1], "de"), (None, texts[0], "en"), (None, "own", None), (3, "another text", "en")] + [docs[20]] * 3
    labels = [(i, [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for i in range(0, 150, 2)]
    return docs, labels + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]


def test_audit_of_odd_documents(spark):
    docs, labels = odd_documents()
    assert audit_of(spark, docs, labels) == plain_audit(docs, labels)
    assert audit_of(spark, docs, []) == plain_audit(docs, [])
    assert audit_of(spark, [], labels) == {}


def test_contractions_of_random_tensors():
    counts = np.random.default_rng(1).integers(0, 9, (3, 2, 2, 2, 2, 2))
    found = filter_audit.contractions(counts)
    for line, (order, step) in enumerate((o, s) for o in filter_audit.ORDERS for s in range(5)):
        index = [slice(None)] * 5
        for f in order[:step]:
            index["ABCDE".index(f)] = 0
        index["ABCDE".index(order[step])] = 1
        assert found["removed"][line] == counts[0][tuple(index)].sum() and found["toxic_lost"][line] == counts[2][tuple(index)].sum()


# Hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=5):
    good = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    width = Counter(len(v) for _, _, v in good).most_common(1)[0][0] if good else 0
    good = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in good if len(v) == width]
    out = []
    for i, label, v in {(i, l, tuple(v)) for i, l, v in good if anchors(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in good]
        own = sorted((s, j) for s, j, m in scored if m == label and j != i)[:positives]
        for p, j in own:
            other = sorted((s, k) for s, k, m in scored if m != label and 80 * -p <= 100 * -s <= 100 * -p)[:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(other, 1)]
    return sorted(out)


def mined(spark, rows, **kwargs):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, rank string")
    found = hard_negatives.mined(frame, F.col("vec_id") % 100 == 0, **kwargs).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("cells", [1 << 18, 64 * 8])
def test_negatives_with_ties_repeats_and_odd_vectors(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", 1 << 10)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, int(rng.integers(4)), (base + rng.normal(size=8) * 0.2).round(2).tolist()) for i in range(900)]
    rows += [(900 + i, i % 4, rows[100][2]) for i in range(80)]  # copies of an anchor's vector
    rows += [rows[200], rows[200], (300, 1, rows[5][2]), rows[17]]
    rows += [(1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [1.0, None] + [0.0] * 6), (1300, 2, [float("nan")] * 8)]
    rows += [(1400, 2, [float("inf")] * 8), (1500, 3, [1.0]), (None, 1, rows[0][2]), (1600, 1, [0.0] * 8), (1700, 9, (-base).tolist()), (1800, 1, [])]
    expected = plain_negatives(rows, lambda i: i % 100 == 0)
    assert len(expected) > 100 and mined(spark, rows) == expected


def test_few_rows_and_none(spark):
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.4, 0.4]), (3, 1, [0.0, 0.0])]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 100 == 0) != []
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []


@pytest.mark.parametrize(("size", "shift"), [(3, 0), (300, 0), (1 << 20, 5), (1 << 24, 0), (1 << 27, -(1 << 27)), (1 << 29, 7), (5, 1 << 36)])
def test_packed_products_are_exact_at_any_width(size, shift):
    rng = np.random.default_rng(size)
    a, c = (rng.integers(-size, size + 1, (rows, 6)).astype(float) + shift for rows in (5, 23))
    expected = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in c] for u in a]
    if max(abs(s) for row in expected for s in row) < 2**63:
        assert hard_negatives.packed_scores(a, c).tolist() == expected
    else:
        with pytest.raises(OverflowError):
            hard_negatives.packed_scores(a, c)


# Disclosure

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_base(text):
    found = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]
            if ok():
                value = m.group().lower() if kind == "email" else m.group() if kind == "ip" else digits
                found.append((kind, m.start(), m.end(), value))
    return found


LETTERS = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"


def plain_terms(text, base):
    """(entity, term, start, end) of whole words of letters in the contexts of base spans."""
    out = []
    for kind in dict(PLAIN):
        every = [m.span() for m in re.finditer(dict(PLAIN)[kind], text) if kind != "card" or 16 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
        edges = [0, *(x for span in every for x in span), len(text)]
        pieces = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
        for n, (start, end) in enumerate(every):
            for value in [v for k, s, _, v in base if k == kind and s == start]:
                (a, b), (c, d) = pieces[n], pieces[n + 1]
                left = (" " if n == 0 else "") + text[a:b]
                right = text[c:d] + (" " if n == len(every) - 1 else "")
                cut = left[-64:]
                for context, origin in ((cut, start - len(cut)), (right[:64], end)):
                    for t in re.finditer(rf"(?<=[{BLANK}])[^{BLANK}]+(?=[{BLANK}])", context):
                        core = re.fullmatch(rf"((?:[^\w{BLANK}]|_)*)({LETTERS})(?:[^\w{BLANK}]|_)*", t.group())
                        if core and len(core[2]) >= 3:
                            at = origin + t.start() + len(core[1])
                            out.append((kind + value, core[2].lower(), at, at + len(core[2])))
    return out


def plain_spans(texts):
    texts = [t or "" for t in texts]
    base = [plain_base(t) for t in texts]
    near = [plain_terms(t, b) for t, b in zip(texts, base, strict=True)]
    d_t = Counter(w for t in texts for w in set(re.findall(LETTERS, t.lower())))
    d_e = Counter(e for b in base for e in {k + v for k, _, _, v in b})
    d = Counter(p for n in near for p in {(e, t) for e, t, _, _ in n})
    total, out = len(texts), []
    for b, n in zip(base, near, strict=True):
        flagged = set()
        for e, t, start, end in n:
            own = math.log(total / d_e[e])
            if d[e, t] >= 2 and own > 0 and math.log(total * d[e, t] / (d_t[t] * d_e[e])) / own >= 0.8 - 1e-12:
                flagged.add(("term", start, end))
        listed = [f"{k}:{s}:{e}" for k, s, e, _ in b]
        counts = tuple(sum(k == kind for k, *_ in b) for kind, _ in PLAIN)
        text = ",".join(listed + [f"{k}:{s}:{e}" for k, s, e in sorted(flagged)])
        out.append((*counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), text))
    return out


CASES = [
    "mail a.b@c.de, x@y, p@q@r.st. me@x.y_z@v.w end", "@a.b a@.b a@b. a@b..c a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 0255.1.1.01 1.2.3 12.1.1.1.",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111  111111111111 4 4111111111111111", "card 4012888888881881-", "+1 (555) 555-0100 +49 30 1234 +1 +() 5 +123456789012345678 +1 2 3 4 5 6 7 8",
    "Ärger über 😀😀 jürgen@exämple.com und jurgen@example.com, +1 555 555 0100 😀", None, "", " ", "7" * 30_000, "1." * 20_000, "a@b" * 20_000, "a." * 20_000 + "@x.y", "+" + "1 " * 30_000, "x" * 60_000 + "@" + "y." * 20_000 + "z",
]


def corpus():
    rng = np.random.default_rng(8)
    words = [f"common{chr(97 + i)}" for i in range(12)]
    texts = list(CASES)
    for i in range(260):
        body = [str(words[k]) for k in rng.integers(0, 12, 40)]
        if i % 20 == 0:
            body[20:20] = ["Contact", "Zacharias", "(Brimble-Smith),", "zbrimble@example.com", "or"]
        if i % 33 == 0:
            body[5:5] = ["O'Rowe:", "+1 (555) 555-0199", "the"]
        texts.append(" ".join(body))
    return texts + texts[20:24] + ["Zacharias was named here."]


def test_spans_equal_a_plain_version(spark):
    texts = corpus()
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]  # repeated and null ids
    frame = spark.createDataFrame([(i, t, "clash", n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, spans string, row long")
    found = disclosure.found_spans(frame).collect()
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found)
    expected = Counter((i, *s) for i, s in zip(ids, plain_spans(texts), strict=True))
    assert got == expected
    assert sum(r.n_term for r in found) >= 26 and "term" in plain_spans(texts)[len(CASES)][-1]
    assert disclosure.found_spans(frame.where("false")).count() == 0


def test_counts_without_broadcast_are_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    first = sorted(map(tuple, disclosure.found_spans(frame).collect()))
    monkeypatch.setattr(disclosure, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, disclosure.found_spans(frame).collect())) == first


def test_sanitised_texts(spark):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, pieces string")
    clean = {r.doc_id: (r.text, r.pieces) for r in disclosure.sanitised(frame).collect()}
    assert len(clean) == len(texts) and all(p == str(i) for i, (_, p) in clean.items())
    assert clean[0][0] == "mail [EMAIL], x@y, p@[EMAIL]. [EMAIL][EMAIL] end" and clean[7][0] is None and clean[len(texts) - 1][0] == texts[-1]
    for i, text in enumerate(texts):
        assert not plain_base(clean[i][0] or "") or i < len(CASES)
        if text and "zbrimble" in text:
            assert "[EMAIL]" in clean[i][0] and "Brimble" not in clean[i][0]


def test_plan_has_no_python(spark):
    docs = queries.table(spark, SF, "documents")
    plan = disclosure.found_spans(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_words_of_texts_are_bytes():
    import pyarrow as pa

    coded = coded_words(pa.array([b"a b", b"", b"b"], pa.binary()), bytes(range(256)))
    assert [coded.distinct[i].as_py() for i in coded.codes] == [b"a", b"b", b"b"] and coded.starts.tolist() == [0, 2, 2, 3]
