"""Column expressions. All are built-in Spark functions."""

from __future__ import annotations

import random
import time
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.schemas import MONEY, TOTAL

# Fixed value: the top seller's share of their own monthly total.
INCENTIVE_RATE = Decimal("0.01")


def money(value: Column | str) -> Column:
    return F.col(value).cast(MONEY) if isinstance(value, str) else value.cast(MONEY)


def month_start(day: Column | str) -> Column:
    """First day of the month: a four-byte grouping key instead of a string."""
    return F.trunc(day, "MM")


def month_of(day: Column | str) -> Column:
    """The month as ``yyyy-MM``."""
    return F.date_format(day, "yyyy-MM")


def month_to_date(month: Column | str) -> Column:
    """``yyyy-MM`` back to the first day of that month."""
    return F.to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def full_name(first: Column | str, last: Column | str) -> Column:
    """First and last name with a space; null when either part is null."""
    return F.concat(first, F.lit(" "), last)


def pack_extras(columns: Sequence[Column]) -> Column:
    """Columns a file has beyond the mandatory ones, as one string in header order.

    Null cells are skipped, so a row whose extras are all null gets ``''``; a file without
    extra columns gets null.
    """
    return F.concat_ws(", ", *columns) if columns else F.lit(None).cast("string")


def sum_or_zero(value: Column | str) -> Column:
    """Sum of a group, with 0 for a group of nulls so that it never outranks a real total."""
    return F.coalesce(F.sum(value), F.lit(Decimal("0.00")))


def incentive_amount(total: Column | str, wins: Column) -> Column:
    """The winner's share of the total rounded half up to cents, 0 for everyone else."""
    total = F.col(total) if isinstance(total, str) else total
    return F.when(wins, F.round(total * F.lit(INCENTIVE_RATE), 2)).otherwise(F.lit(Decimal("0.00"))).cast(TOTAL)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def try_typed(raw: Column, data_type: T.DataType) -> Column:
    """Cast text to the declared type, null when it does not parse or would lose something.

    Money with more decimals than the type holds and dates that aren't whole ``yyyy-MM-dd`` are null, not rounded or completed.
    """
    if isinstance(data_type, T.StringType):
        return raw
    text = F.trim(raw)
    if isinstance(data_type, T.DecimalType):
        fits = text.rlike(rf"^[+-]?([0-9]+(\.[0-9]{{0,{data_type.scale}}}0*)?|\.[0-9]{{1,{data_type.scale}}}0*)$")
    elif isinstance(data_type, T.DateType):
        fits = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    else:
        # A failing cast of a whole number makes and drops an exception with its message. Three looks at the text spare most of them; a pattern
        # would cost every good cell more.
        begins = (text > "") & ((text < ":") | text.startswith("\x7f"))
        ends = (F.substring(text, -1, 1) < ":") | text.endswith("\x7f")
        fits = begins & ends & ~F.contains(text, F.lit("."))
    return F.when(fits, text.try_cast(data_type))


def new_run_id() -> int:
    """Epoch microseconds and ten random bits: later runs have larger ids, and two in one instant differ."""
    return time.time_ns() // 1000 * 1024 + random.getrandbits(10)


def run_started(run_id: Column | str) -> Column:
    """When a run got its id."""
    return F.timestamp_micros((F.col(run_id) if isinstance(run_id, str) else run_id).cast("bigint") / 1024)
