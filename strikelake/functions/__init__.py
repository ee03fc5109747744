from strikelake.functions.columns import (
    is_call,
    is_weekday,
    one_decimal,
    parse_date,
    parse_double,
    percent,
    side,
    upper_median,
    weekday_from_ordinal,
    weekday_ordinal,
)

__all__ = [
    "is_call",
    "is_weekday",
    "one_decimal",
    "parse_date",
    "parse_double",
    "percent",
    "side",
    "upper_median",
    "weekday_from_ordinal",
    "weekday_ordinal",
]
