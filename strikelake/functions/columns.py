"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Monday; weekday ordinals count Monday to Friday from here.
_MONDAY = "1970-01-05"


def parse_date(text: Column) -> Column:
    """ISO date text to a date, null when it does not start with yyyy-mm-dd.

    The pattern test keeps partial dates such as ``2024`` null, which a bare cast accepts.
    """
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text).try_cast("date")


def parse_double(text: Column) -> Column:
    """Decimal text to a double, null when it is not a number.

    The JVM parser also takes the Java literal suffixes d and f (``1.5f``); those are no numbers
    in a data file, so they are nulled, while ``inf`` keeps its f.
    """
    t = F.trim(text)
    suffixed = (
        t.endswith("d")
        | t.endswith("D")
        | ((t.endswith("f") | t.endswith("F")) & ~F.lower(t).endswith("inf"))
    )
    return F.when(~suffixed, t).try_cast("double")


def is_call(option_type: Column) -> Column:
    """Coverage rule: exactly ``call`` in any case is a call, all else a put."""
    return F.lower(option_type) == "call"


def side(option_type: Column) -> Column:
    """Resume rule: first letter in any case, ``c`` or ``p``; null when there is none."""
    first = F.lower(F.substring(option_type, 1, 1))
    return F.when(first == "c", "call").when(first == "p", "put")


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, null for an empty whole instead of an error."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded half to even on the exact binary value."""
    return F.call_function("format_number", value, F.lit("0.0"))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def weekday_ordinal(day: Column) -> Column:
    """Count of weekdays up to and including ``day``; a weekend has its Friday's number."""
    k = F.datediff(day, F.lit(_MONDAY).cast("date"))
    dow = F.pmod(k, F.lit(7))
    return (((k - dow) / 7) * 5 + F.least(dow, F.lit(4))).cast("int")


def weekday_from_ordinal(ordinal: Column) -> Column:
    """Inverse of :func:`weekday_ordinal` for Monday to Friday."""
    dow = F.pmod(ordinal, F.lit(5))
    return F.date_add(F.lit(_MONDAY).cast("date"), (((ordinal - dow) / 5) * 7 + dow).cast("int"))


def upper_median(values: Column) -> Column:
    """Element n/2 (from zero) of the sorted array: for an even count the upper of the two.

    An empty array has none.
    """
    return F.get(F.sort_array(values), (F.size(values) / 2).cast("int"))
