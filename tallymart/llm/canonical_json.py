"""Canonical JSON in DataFrame functions: sorted keys, no white space, one form for equal numbers, no change of value.

A parser would turn numbers into 64-bit ones. So a text's tokens are tagged first: a number becomes the string "n" and its canonical digits,
a string gets an "s" before it. The tagged text is parsed as a variant, which checks it and sorts keys, and is
written again; then the tags are taken off. Equal numbers have one form however they are written: digits without
superfluous zeros; plain from 1e-6 up to 21 digits before the point, else with an exponent (the layout of RFC 8785, but with
all digits). An exponent of more than ``EXPONENT`` digits is beyond that: such a number stays as it is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
TOKENS = rf'(?s){STRING}|{NUMBER}|[^"0-9-]++|.'
EXPONENT = 15
MOST_PLAIN, LEAST_PLAIN = 21, -6


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def canonical_number(token: Column) -> Column:
    """A JSON number in its one form."""

    def parts(t: Column) -> Column:
        mantissa = F.regexp_extract(t, r"^-?([0-9.]+)", 1)
        whole, fraction = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
        power = F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1)
        return F.struct(
            F.concat(whole, fraction).alias("digits"), F.length(whole).cast("bigint").alias("point"),
            F.when(power == "", F.lit(0).cast("bigint")).otherwise(F.regexp_replace(power, r"^\+", "").try_cast("bigint")).alias("power"),
        )

    def stripped(held: Column) -> Column:
        digits = F.regexp_replace(held["digits"], "^0+", "")
        zeros = F.length(held["digits"]) - F.length(digits)
        return F.struct(F.regexp_replace(digits, "0+$", "").alias("d"), (held["point"] + held["power"] - zeros).alias("p"))

    def written(held: Column) -> Column:
        d, p = held["d"], held["p"]
        n = F.length(d)
        place = p.cast("int")
        more = p - 1
        rest = F.when(n > 1, F.concat(F.lit("."), d.substr(F.lit(2), n))).otherwise("")
        return (
            F.when(d == "", "0")
            .when((p >= n) & (p <= MOST_PLAIN), F.rpad(d, place, F.lit("0")))
            .when((p > 0) & (p <= MOST_PLAIN), F.concat(d.substr(F.lit(1), place), F.lit("."), d.substr(place + 1, n)))
            .when((p > LEAST_PLAIN) & (p <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -place), d))
            .otherwise(F.concat(F.substring(d, 1, 1), rest, F.when(more < 0, "e-").otherwise("e+"), F.abs(more).cast("string")))
        )

    huge = token.rlike(rf"[eE][+-]?0*[1-9][0-9]{{{EXPONENT},}}$") & token.rlike("^-?[0.]*[1-9]")
    sign = F.when(F.substring(token, 1, 1) == "-", "-").otherwise("")
    unsigned = bound(bound(bound(token, parts), stripped), written)
    signed = F.when(unsigned == "0", "0").otherwise(F.concat(sign, unsigned))
    return (
        F.when(token.rlike("^-?[1-9][0-9]{0,14}$"), token)
        .when(huge, F.lower(token))
        .otherwise(F.coalesce(signed, F.lit("0")))
    )


def tagged(text: Column) -> Column:
    """JSON with every number as a string of "n" and its digits, and "s" before every other string. What is no JSON stays so."""

    def one(token: Column) -> Column:
        return (
            F.when(token.rlike('(?s)^".*"$') & (F.length(token) > 1), F.concat(F.lit('"s'), token.substr(F.lit(2), F.length(token))))
            .when(token.rlike("^-?[0-9]"), F.concat(F.lit('"n'), canonical_number(token), F.lit('"')))
            .otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), one), "")


def untagged(text: Column) -> Column:
    """Written tagged JSON without its tags."""

    def one(token: Column) -> Column:
        body = token.substr(F.lit(3), F.length(token))
        return (
            F.when(token.startswith('"s'), F.concat(F.lit('"'), body))
            .when(token.startswith('"n'), body.substr(F.lit(1), F.length(body) - 1))
            .otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf'(?s){STRING}|[^"]++'), F.lit(0)), one), "")


def parsed(text: Column) -> Column:
    """The tagged variant of a JSON text; null if it is none.

    The parser passes over what follows a value. Within an object and within an array alike nothing can follow. A number is no key.
    """
    one = tagged(text)
    one = F.when(~one.rlike(r'"n[0-9eE.+-]+"[\x20\t\r\n]*+:'), one)
    inside = F.try_parse_json(F.concat(F.lit('{"s":'), one, F.lit("}")))
    alone = F.try_parse_json(F.concat(F.lit("["), one, F.lit("]"))).isNotNull()
    return F.when(alone, F.try_variant_get(inside, "$.s", "variant"))


def serialised(value: Column) -> Column:
    """Canonical JSON of a tagged variant."""
    return untagged(F.to_json(value))


def kind_of(value: Column) -> Column:
    """The JSON type of a tagged variant: string, integer, number, boolean, array, object or null. A whole number is an integer, however written."""
    schema = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    plain = text.rlike("^n-?[0-9]+$")
    digits = F.length(F.regexp_extract(text, r"\.([0-9]+)e", 1))
    power = F.regexp_extract(text, r"e\+([0-9]+)$", 1)
    raised = (power != "") & (digits <= F.when(power != "", power).try_cast("bigint"))
    return (
        F.when(schema == "STRING", F.when(text.startswith("s"), "string").when(plain | F.coalesce(raised, F.lit(False)), "integer").otherwise("number"))
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
    )


def fields_of(value: Column) -> Column:
    """Fields of a tagged object by their tagged names; null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))


def below(value: Column, path: Column) -> Column:
    """What a tagged value holds below some keys, one inside the other; null if there is nothing."""
    return F.aggregate(path, value, lambda v, key: F.try_element_at(fields_of(v), F.concat(F.lit("s"), key)))


def number_of(value: Column) -> Column:
    """A tagged number as a double, for comparisons; null for anything else."""
    text = F.try_variant_get(value, "$", "string")
    return F.when((F.schema_of_variant(value) == "STRING") & text.startswith("n"), F.substring(text, 2, 1 << 30).try_cast("double"))
