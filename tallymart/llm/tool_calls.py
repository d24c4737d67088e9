"""Linking tool calls to their results, in DataFrame functions only.

Calls and results are hash-joined by (conversation, call id). A call may name one call it comes after; the chains are
followed by pointer doubling, so a chain of n calls takes about log2(n) joins, and calls on a cycle are found as those
that never reach a beginning. (depth, turn, call id) is then a topological order. Arguments are parsed as variants,
checked against the tool's parameters - types, allowed values, ranges, and the same for what lies inside objects -, and written
again as canonical JSON (see canonical_json): sorted keys, no white space, one form for equal numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.canonical_json import below, fields_of, kind_of, number_of, parsed, serialised
from tallymart.llm.common import written

TURNS_PER_RANGE = 1024

#: What a parameter may have besides name, parameter, type and required: keys below it, canonical values, least and greatest number.
OPTIONAL = {"path": "array<string>", "enum": "array<string>", "minimum": "double", "maximum": "double"}


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls (conv_id, call_id, after): how many calls must come before; null on or behind a cycle.

    ``after`` that names no call of the conversation counts as none. (conv_id, call_id) must be unique and not null.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"))
    own = calls.select("conv_id", "call_id", "after").join(known.withColumn("there", F.lit(True)), ["conv_id", "after"], "left")
    state = own.select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")
    )
    state = written(state, "depths")
    most = state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(most.bit_length() + 1):
        if state.where("up is not null").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = written(
            state.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "depths",
        )
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _first(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of rows that share (conv_id, call_id) the first by turn and content, and how many there are."""
    return (
        rows.where("conv_id is not null and call_id is not null")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct(*names)).alias("first"), F.count(F.lit(1)).alias("n"))
        .select("conv_id", "call_id", "first.*", "n")
    )


def _tools(parameters: DataFrame) -> DataFrame:
    """(name, parameters) with the optional columns filled up and allowed values in canonical form."""
    for column, kind in OPTIONAL.items():
        if column not in parameters.columns:
            parameters = parameters.withColumn(column, F.lit(None).cast(kind))
    full = F.concat(F.array("parameter"), F.coalesce("path", F.array().cast("array<string>")))
    allowed = F.transform("enum", lambda text: serialised(parsed(text)))
    one = F.struct(full.alias("path"), "type", "required", allowed.alias("enum"), "minimum", "maximum")
    return parameters.groupBy("name").agg(F.array_sort(F.collect_set(one)).alias("parameters"))


def _errors() -> Column:
    """Array of what is wrong with the object ``parsed`` against ``parameters``."""
    given, parameters = F.col("parsed"), F.col("parameters")

    def wrong(p: Column) -> Column:
        label = F.array_join(p["path"], ".")
        value, parent = below(given, p["path"]), below(given, F.slice(p["path"], F.lit(1), F.size(p["path"]) - 1))
        kind, number = kind_of(value), number_of(value)
        fits = (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer"))
        found = {
            "missing ": p["required"] & value.isNull() & (kind_of(parent) == "object"),
            "type of ": value.isNotNull() & ~F.coalesce(fits, F.lit(False)),
            "value of ": p["enum"].isNotNull() & value.isNotNull() & ~F.array_contains(p["enum"], serialised(value)),
            "range of ": (number < p["minimum"]) | (number > p["maximum"]),
        }
        return F.array(*[F.when(holds, F.concat(F.lit(what), label)) for what, holds in found.items()])

    names = F.transform(parameters, lambda p: F.concat(F.lit("s"), F.element_at(p["path"], 1)))
    unknown = F.transform(
        F.filter(F.map_keys(fields_of(given)), lambda k: ~F.array_contains(names, k)),
        lambda k: F.concat(F.lit("unknown "), k.substr(F.lit(2), F.length(k))),
    )
    found = F.array_compact(F.flatten(F.transform(parameters, wrong)))
    return (
        F.when(parameters.isNull(), F.array(F.lit("unknown tool")))
        .when(given.isNull() | (kind_of(given) != "object"), F.array(F.lit("arguments are no object")))
        .otherwise(F.array_sort(F.concat(found, unknown)))
    )


def linked(calls: DataFrame, results: DataFrame, parameters: DataFrame, orphans: bool = False) -> DataFrame:
    """One row for each call, with its result, its place in the conversation and its canonical JSON.

    With ``orphans`` also one row for each id that has results and no call: its status is ``orphan``, it has no turn,
    name, errors or arguments, ``calls`` is 0, and its position is after all calls, by the result's turn.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after. ``results``: conv_id, call_id, turn, content.
    ``parameters``: name, parameter, type (a JSON type; a whole number is an integer however it is written), required, and those of
    ``OPTIONAL`` that are needed: a parameter with a ``path`` describes what lies below these keys, and is missing only where the
    object around it is there. Of several calls or results of one id the first by
    turn and content counts, ``calls`` and ``results`` say how many there were; rows without an id are left out.
    ``status`` is ``cyclic``, ``invalid``, ``unanswered`` or ``ok``, the first that holds. ``position`` counts from 1
    in the order of (depth, turn, call_id); calls on a cycle come last.
    """
    own = written(_first(calls, ["turn", "name", "arguments", "after"]).withColumnRenamed("n", "calls"), "calls")
    answers = _first(results, ["turn", "content"]).select(
        "conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("n").alias("results")
    )
    tools = _tools(parameters)
    orphan = F.col("calls").isNull()
    joined = (
        own.join(depths(own), ["conv_id", "call_id"])
        .join(answers, ["conv_id", "call_id"], "full" if orphans else "left")
        .join(tools, "name", "left")
        .withColumn("parsed", parsed(F.col("arguments")))
        .withColumn("errors", F.when(orphan, F.array().cast("array<string>")).otherwise(_errors()))
    )
    status = (
        F.when(orphan, "orphan")
        .when(F.col("depth").isNull(), "cyclic")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("results").isNull(), "unanswered")
        .otherwise("ok")
    )
    text = F.concat(
        F.lit('{"after":'), F.coalesce(_quoted("after"), F.lit("null")),
        F.lit(',"arguments":'), F.coalesce(serialised(F.col("parsed")), _quoted("arguments"), F.lit("null")),
        F.lit(',"id":'), _quoted("call_id"),
        F.lit(',"name":'), F.coalesce(_quoted("name"), F.lit("null")),
        F.lit(',"result":'), F.coalesce(_quoted("content"), F.lit("null")), F.lit("}"),
    )
    rows = written(
        joined.select(
            "conv_id", "call_id", "turn", "name", "after", "depth", "result_turn",
            F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"), "errors", status.alias("status"), text.alias("json"),
        ),
        "linked",
    )
    # Places are counted within ranges of turns of one depth; only counts of ranges meet for a conversation.
    last = F.when(F.col("status") == "orphan", F.lit(2**62 + 1)).otherwise(F.coalesce("depth", F.lit(2**62)))
    placed = rows.withColumn("level", last).withColumn("at", F.when(F.col("status") == "orphan", F.col("result_turn")).otherwise(F.col("turn")))
    ranged = placed.withColumn("part", F.expr(f"at div {TURNS_PER_RANGE}"))
    counts = ranged.groupBy("conv_id", "level", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("conv_id").alias("c"), F.col("level").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("conv_id", "level", "part").orderBy("at", "call_id"))
    same = (F.col("conv_id") == F.col("c")) & (F.col("level") == F.col("l")) & F.col("part").eqNullSafe(F.col("p"))
    return ranged.withColumn("inside", inside).join(before, same).select(*rows.columns, (F.col("before") + F.col("inside")).alias("position"))


def _quoted(name: str):
    """A string as JSON; null stays null."""
    as_list = F.to_json(F.array(F.col(name).cast("string")))
    return F.when(F.col(name).isNotNull(), as_list.substr(F.lit(2), F.length(as_list) - 2))
