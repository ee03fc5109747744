"""Records (maps of strings) to the typed options table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions import parse_date, parse_double
from strikelake.schemas import API_FIELDS, OPTION_DATES, OPTION_STRINGS


def _text_of(record: Column, name: str) -> Column:
    """A field by its API name, or by the table's own name where a page already uses that."""
    api = next(a for a, column in API_FIELDS.items() if column == name)
    found = record[api]
    return found if api == name else F.coalesce(found, record[name])


def normalize_quotes(rows: DataFrame, record: str = "record") -> DataFrame:
    """Rename, lower-case and cast the known fields; others stay as text in ``extras``.

    A value that does not parse becomes null. Columns of ``rows`` other than the record (page and
    position, which order the rows) are kept behind the table's columns.
    """
    r = F.col(record)
    known = set(API_FIELDS) | set(API_FIELDS.values())
    columns = []
    for name in API_FIELDS.values():
        text = _text_of(r, name)
        if name == "option_type":
            value = F.lower(text)
        elif name in OPTION_DATES:
            value = parse_date(text)
        elif name in OPTION_STRINGS:
            value = text
        else:
            value = parse_double(text)
        columns.append(value.alias(name))
    # As many known fields as there are fields: none is left over, and none is looked at by itself.
    found = reduce(Column.__add__, [r[name].isNotNull().cast("int") for name in sorted(known)])
    left = F.map_filter(r, lambda k, _: ~k.isin(*known))
    extras = F.when(found == F.size(r), F.create_map().cast("map<string,string>")).otherwise(left).alias("extras")
    carried = [c for c in rows.columns if c != record and c not in API_FIELDS.values()]
    return rows.select(*columns, extras, *carried)
