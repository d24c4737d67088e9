from tallymart.functions.columns import (
    base_name,
    full_name,
    incentive_amount,
    money,
    month_of,
    month_start,
    month_to_date,
    new_run_id,
    pack_extras,
    sum_or_zero,
    try_typed,
)

__all__ = [
    "base_name",
    "full_name",
    "incentive_amount",
    "money",
    "month_of",
    "month_start",
    "month_to_date",
    "new_run_id",
    "pack_extras",
    "sum_or_zero",
    "try_typed",
]
