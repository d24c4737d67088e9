"""Information-theoretic sanitisation: personal data, and the words near it that give it away. DataFrame functions only.

Four kinds of personal data are found by pattern: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.
Their distinct values are the protected entities. A word of letters within ``CONTEXT`` code points of an entity is a term of
its context. Counting documents over the whole corpus - with the entity (d_e), with the term (d_t), with the term in the
entity's context (d) - gives the term's pointwise mutual information with the entity, and by what share of the
entity's own information a reader is informed who sees the term:

    disclosure = ln(N d / (d_t d_e)) / ln(N / d_e)

1 means that the term occurs where the entity does and nowhere else. Terms whose disclosure is ``THRESHOLD`` or more, seen together in
``LEAST`` documents at least, are spans of kind "term" wherever they stand in that entity's context. ``sanitised`` puts the name
of its kind in the place of each span: terms from ``REMOVED`` on are removed, weaker ones generalised to [TERM].

The patterns are written with possessive quantifiers and start only where a match can, so that a long run of digits or of letters
costs one pass and no deep recursion. Positions are code points from running sums over the pieces between matches.

Odd input: a null text is empty and has no spans; null and repeated ids are rows of their own. Equal values in copies
of a text count as documents of their own. An entity in every document has no information to disclose. Other columns
are not read by ``found_spans`` and are kept by ``sanitised``. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import common

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    # Runs of 16 to 19 digits alone; longer and shorter ones never pass.
    "card": r"[0-9](?<![0-9][\x20-]?[0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind can't occur.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
OCTETS = r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|\z)){4}\z"

BLANK = r"[\x20\x09-\x0D]"
TOKEN = rf"(?<={BLANK})[^\x20\x09-\x0D]++(?={BLANK})"
WORD = r"\p{L}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
EDGE = r"[\p{P}\p{S}]*+"

CONTEXT = 64
LEAST = 2
THRESHOLD = 0.8
REMOVED = 0.95
LETTERS = 3
#: Up to so many terms are broadcast, so that other words are dropped before they are counted.
BROADCAST_TERMS = 200_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """True for up to 20 digits whose Luhn sum is a multiple of ten."""
    padded = F.lpad(digits, 20, "0")
    parts = []
    for i in range(1, 21):
        digit = F.substring(padded, i, 1).cast("int")
        parts.append(digit if i % 2 == 0 else digit * 2 - F.when(digit > 4, 9).otherwise(0))
    return reduce(lambda a, b: a + b, parts) % 10 == 0


def is_valid(kind: Column, match: Column) -> Column:
    long_enough = F.length(_digits(match)).between(8, 15)
    return (
        F.when(kind == KINDS.index("ip"), match.rlike(OCTETS))
        .when(kind == KINDS.index("card"), passes_luhn(_digits(match)))
        .when(kind == KINDS.index("phone"), long_enough)
        .otherwise(True)
    )


def _entity(kind: Column, match: Column) -> Column:
    """The protected value, however it is written."""
    email, ip = (kind == KINDS.index(k) for k in ("email", "ip"))
    value = F.when(email, F.lower(match)).when(ip, match).otherwise(_digits(match))
    return F.concat(kind.cast("string"), F.lit(":"), value)


def matches(rows: DataFrame) -> DataFrame:
    """Adds ``matches`` to rows with a text: kind, place among its kind, length of the piece before it, the match and its contexts."""
    text, none = F.col("text"), F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if kind in NEEDED:
            found = F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(none)
        rows = rows.withColumn(f"m_{kind}", found)
    # Pieces are cut only where there is a match.
    rows = rows.withColumns({f"s_{k}": F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)) for k, p in PATTERNS.items()})

    def described(kind: str) -> Column:
        pieces, many = F.col(f"s_{kind}"), F.size(f"m_{kind}")

        def one(match: Column, i: Column) -> Column:
            before, after = F.get(pieces, i), F.get(pieces, i + 1)
            # Text ends where a blank could stand; a word that touches the match is no word of its own.
            left = F.when(i == 0, F.concat(F.lit(" "), before)).otherwise(before)
            right = F.when(i == many - 1, F.concat(after, F.lit(" "))).otherwise(after)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(before).alias("gap"), match.alias("match"),
                F.substring(left, -CONTEXT, CONTEXT).alias("before"), F.substring(right, 1, CONTEXT).alias("after"),
            )

        return F.transform(F.col(f"m_{kind}"), one)

    helpers = [f"{c}_{k}" for c in "ms" for k in PATTERNS]
    return rows.withColumn("matches", F.concat(*[described(k) for k in PATTERNS])).drop("text", *helpers)


def base_spans(found: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, entity, before and after of every match that passes its check."""
    each = found.where(F.size("matches") > 0).select("row", "doc_id", F.inline("matches"))
    earlier = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("match")
    start = F.coalesce(F.sum(F.col("gap") + size).over(earlier), F.lit(0)) + F.col("gap")
    placed = each.withColumn("start", start.cast("long")).where(is_valid(F.col("kind"), F.col("match")))
    return placed.select(
        "row", "doc_id", "kind", "start", (F.col("start") + size).alias("end"), _entity(F.col("kind"), F.col("match")).alias("entity"), "before", "after"
    )


def _tokens(context: Column, origin: Column) -> Column:
    """(token, start) of the words of a short context whose first code point stands at ``origin``."""
    tokens, gaps = F.regexp_extract_all(context, F.lit(TOKEN), F.lit(0)), F.split(context, TOKEN, -1)
    return F.transform(
        tokens,
        lambda token, i: F.struct(
            token.alias("token"),
            (origin + F.length(F.array_join(F.slice(tokens, F.lit(1), i), "")) + F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), ""))).alias("start"),
        ),
    )


def contexts(spans: DataFrame) -> DataFrame:
    """row, doc_id, entity, term, start and end of every word of letters in the context of a base span."""
    near = F.concat(_tokens(F.col("before"), F.col("start") - F.length("before")), _tokens(F.col("after"), F.col("end")))
    each = spans.select("row", "doc_id", "entity", F.inline(near))
    core = F.regexp_extract("token", rf"\A{EDGE}({WORD}){EDGE}\z", 1)
    lead = F.length(F.regexp_extract("token", rf"\A{EDGE}", 0))
    placed = each.select("row", "doc_id", "entity", core.alias("core"), (F.col("start") + lead).alias("start")).where(F.length("core") >= LETTERS)
    return placed.select("row", "doc_id", "entity", F.lower("core").alias("term"), "start", (F.col("start") + F.length("core")).alias("end"))


def document_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, d_t: the number of texts that hold each of ``terms`` (and maybe others) as a word. Words are counted by task before they are sent."""
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
    words = words.where(F.length("term") >= LETTERS)
    if terms.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("d_t"))


def disclosing(texts: DataFrame, spans: DataFrame, near: DataFrame, total: int) -> DataFrame:
    """entity, term and disclosure of the pairs at or above the threshold."""
    entities = spans.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("d_e"))
    pairs = near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("d"))
    pairs = common.written(pairs.where(F.col("d") >= LEAST), "pairs")
    known = pairs.join(entities, "entity").join(document_counts(texts, pairs.select("term").distinct()), "term")
    own = F.log(F.lit(float(total)) / F.col("d_e"))
    mutual = F.log(F.lit(float(total)) * F.col("d") / (F.col("d_t").cast("double") * F.col("d_e")))
    disclosure = F.when(own > 0, mutual / own).alias("disclosure")
    return known.select("entity", "term", disclosure).where(F.col("disclosure") >= THRESHOLD)


def grouped_spans(rows: DataFrame) -> DataFrame:
    """row, doc_id and the sorted array ``spans`` (kind, start, end, disclosure) of rows (row, doc_id, text)."""
    texts = rows.select(F.coalesce("text", F.lit("")).alias("text"))
    found = common.written(matches(rows.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))), "matches")
    spans = common.written(base_spans(found), "spans")
    near = contexts(spans)
    leaks = common.written(disclosing(texts, spans, near, found.count()), "leaks")
    terms = near.join(leaks, ["entity", "term"]).groupBy("row", "doc_id", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    none = F.lit(None).cast("double").alias("disclosure")
    span = F.struct("kind", "start", "end", "disclosure").alias("span")
    base = spans.select("row", "doc_id", "kind", "start", "end", none).select("row", "doc_id", span)
    added = terms.select("row", "doc_id", F.lit(TERM).alias("kind"), "start", "end", "disclosure").select("row", "doc_id", span)
    # A row whose matches all failed still counts, by a null that no list holds; rows without matches are never shuffled.
    failed = found.where(F.size("matches") > 0).select("row", "doc_id", F.lit(None).cast(base.schema["span"].dataType).alias("span"))
    listed = base.union(added).union(failed).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    return listed.union(found.where(F.size("matches") == 0).select("row", "doc_id", F.array().cast(listed.schema["spans"].dataType)))


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)


def joined(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, checksum of the base spans and all spans of every row of ``docs`` (doc_id, text)."""
    spans = grouped_spans(_numbered(docs, "doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = joined(F.filter("spans", lambda s: s["kind"] < TERM))
    return spans.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by the name of its kind, or removed; overlapping spans are replaced once."""
    rows = common.written(_numbered(docs, F.struct(*docs.columns).alias("doc")), "numbered")
    spans = grouped_spans(rows.select("row", "doc.doc_id", "doc.text")).where(F.size("spans") > 0)
    each = spans.select("row", F.inline("spans"))
    earlier = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("from", F.coalesce(F.max("end").over(earlier), F.lit(0))).where(F.col("end") > F.col("from"))
    label = F.when(F.col("kind") < TERM, F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))), F.lit("]")))
    label = label.when(F.col("disclosure") >= REMOVED, "").otherwise("[TERM]")
    piece = F.struct("from", F.greatest("start", "from").alias("start"), "end", label.alias("label"))
    pieces = each.groupBy("row").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    text, last = F.col("doc.text"), F.element_at("pieces", -1)["end"]
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(cut(p["from"], p["start"]), p["label"])), ""), cut(last, F.length(text)))
    clean = F.when(F.col("pieces").isNotNull(), whole).otherwise(text)
    return rows.join(pieces, "row", "left").select(*[clean.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
