"""Landed API pages: ``{meta.fields, data, links}`` rows to one map of strings per record.

A page is *compact* (array of arrays, names in ``meta.fields``) or *standard* (array of objects,
optionally wrapped in ``attributes``). ``data`` is parsed in two steps, first to its elements and
then each element by itself, so that one malformed record costs that record and not the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelake.schemas import ENVELOPE_SCHEMA

_STRINGS = "array<string>"
_RECORD = "map<string,string>"


def read_pages(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Pages landed as JSON, one per line or, with ``multi_line``, one per file."""
    return spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", multi_line).json(path)


def _elements(data: Column, element: str) -> Column:
    """Each element of ``data`` parsed by itself, null where it has another shape.

    Parsing happens inside the array, ahead of the explode: what comes out of an explode is a
    plain column, so a later use of a record can never parse its text again.
    """
    return F.transform(F.from_json(data, _STRINGS), lambda text: _parsed(text, element))


def _parsed(text: Column, element: str) -> Column:
    """The array or object in a text, else null. What lacks its bracket is neither: no parser is set up for it."""
    return F.when(text.contains("[" if element == _STRINGS else "{"), F.from_json(text, element))


def _drop_nulls(record: Column) -> Column:
    return F.map_filter(record, lambda _, v: v.isNotNull())


def _names(fields: Column) -> Column:
    """Field names by position; of a name given twice only the last position keeps it.

    Names hardly ever repeat, and pages whose names differ are passed through as they are.
    """
    last_only = F.transform(
        fields,
        lambda name, i: F.when(
            ~F.array_contains(F.slice(fields, i + 2, F.size(fields)), name), name
        ),
    )
    differ = F.size(F.array_distinct(fields)) == F.size(fields)
    return F.when(differ, fields).otherwise(last_only)


def _lacks_null(texts: Column) -> Column:
    """Whether an array surely holds no null; where it holds one, or the text that is looked for, not true.

    Looking for a text tells of nulls on the way, without a lambda, which no code is generated for.
    """
    return F.coalesce(~F.array_contains(texts, F.lit("\0")), F.lit(False))


def _all_named(names: Column) -> Column:
    """Whether every position has a name: a name without its position is null, which is no key."""
    return _lacks_null(names)


def _compact_record(names: Column, all_named: Column, cells: Column) -> Column:
    """Zip one row with the names. Short rows leave names out, surplus cells are ignored.

    A row with a cell for every name, none of them null, is a map as it stands.
    """
    length = F.least(F.size(names), F.size(cells))
    plain = F.map_from_arrays(F.slice(names, 1, length), F.slice(cells, 1, length))
    picked = F.filter(
        F.arrays_zip(names.alias("key"), cells.alias("value")),
        lambda p: p["key"].isNotNull() & p["value"].isNotNull(),
    )
    full = all_named & (F.size(names) == F.size(cells)) & _lacks_null(cells)
    return (
        F.when(full, F.map_from_arrays(names, cells))
        .when(all_named, _drop_nulls(plain))
        .otherwise(F.map_from_entries(picked))
    )


def _rows_at_once(data: Column) -> Column:
    """Rows of a compact page parsed in one pass, null where anything but plain rows may be in it.

    Objects and escapes are left to the parsing of each element by itself.
    """
    plain = data.startswith("[[") & ~data.contains("{") & ~data.contains("\\")
    return F.when(plain, F.from_json(data, f"array<{_STRINGS}>"))


def _all_plain(rows: Column) -> Column:
    """Whether all elements were rows, of cells that parsing a row by itself gives as well.

    Without escapes a quote comes only from what is no text: an array of texts, or a number beyond a double.
    """
    whole = F.coalesce(~F.array_contains(rows, F.array(F.lit("\0"))), F.lit(False))
    return whole & ~F.array_join(F.flatten(rows), "").contains('"')


def _standard_record(found: Column) -> Column:
    """The object below ``attributes`` if there is one, else the object itself."""
    return _drop_nulls(F.coalesce(_parsed(found["attributes"], _RECORD), found))


def _fields() -> Column:
    return F.col("meta.fields")


def _is_compact() -> Column:
    return F.size(F.coalesce(_fields(), F.array().cast(_STRINGS))) > 0


def _carried(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c not in ("meta", "data", "links")]


def compact_rows(pages: DataFrame) -> DataFrame:
    """One row per array in ``data``: page columns, ``pos`` in the page, ``record`` map."""
    keep = _carried(pages)
    # The names are made ready before the explode: once per page, not once per row.
    named = pages.select(*keep, _names(_fields()).alias("_names"), "data")
    rows = named.select(
        *keep,
        "_names",
        _all_named(F.col("_names")).alias("_all_named"),
        F.posexplode(_elements(F.col("data"), _STRINGS)).alias("pos", "_cells"),
    )
    return rows.filter(F.col("_cells").isNotNull()).select(
        *keep, "pos", _compact_record(F.col("_names"), F.col("_all_named"), F.col("_cells")).alias("record")
    )


def standard_rows(pages: DataFrame) -> DataFrame:
    """One row per object in ``data``; the object below ``attributes`` if there is one."""
    keep = _carried(pages)
    rows = pages.select(
        *keep, F.posexplode(_elements(F.col("data"), _RECORD)).alias("pos", "_object")
    )
    return rows.filter(F.col("_object").isNotNull()).select(
        *keep, "pos", _standard_record(F.col("_object")).alias("record")
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of any page: compact when it names its fields, else standard.

    Both forms are read in one pass over the pages; a page without data yields nothing. A compact page
    of nothing but rows is parsed at once, any other element by element.
    """
    keep = _carried(pages)
    # Null names mark a standard page. They are made ready once per page, before the explode.
    named = pages.select(
        *keep,
        F.when(_is_compact(), _names(_fields())).alias("_names"),
        F.when(_is_compact(), _rows_at_once(F.col("data"))).alias("_rows"),
        "data",
    )
    # Told ahead of the explode as well, which nothing is generated for.
    all_plain = F.coalesce(_all_plain(F.col("_rows")), F.lit(False)).alias("_plain")
    named = named.select(*keep, "_names", _all_named(F.col("_names")).alias("_all_named"), "_rows", all_plain, "data")
    compact = F.col("_names").isNotNull()
    each = F.transform(
        F.from_json("data", _STRINGS),
        lambda text: F.struct(
            F.when(compact, _parsed(text, _STRINGS)).alias("cells"),
            F.when(~compact, _parsed(text, _RECORD)).alias("object"),
        ),
    )
    at_once = F.transform(
        "_rows", lambda cells: F.struct(cells.alias("cells"), F.lit(None).cast(_RECORD).alias("object"))
    )
    elements = F.when(F.col("_plain"), at_once).otherwise(each)
    rows = named.select(*keep, "_names", "_all_named", F.posexplode(elements).alias("pos", "_e"))
    cells, found = F.col("_e.cells"), F.col("_e.object")
    compact_record = _compact_record(F.col("_names"), F.col("_all_named"), cells)
    record = F.when(cells.isNotNull(), compact_record).otherwise(_standard_record(found))
    return rows.filter(cells.isNotNull() | found.isNotNull()).select(
        *keep, "pos", record.alias("record")
    )


def is_unreadable() -> Column:
    """Whether a page's ``data`` is no JSON at all."""
    broken = F.col("data").isNotNull() & F.try_parse_json("data").isNull()
    # Repeated keys are legal here but not in the variant parser.
    return broken & F.from_json("data", _STRINGS).isNull()


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """Pages whose ``data`` is no JSON at all; they yield no rows and need a warning."""
    return pages.filter(is_unreadable()).select(*_carried(pages))


def symbol_universe(pages: DataFrame) -> DataFrame:
    """Symbols listed by ``data`` of symbol pages, with the pages that are in error.

    ``error`` is null on symbol rows. A page without ``data``, or whose ``data`` is not an array
    of strings only, gives one row with ``error`` set and no symbol.
    """
    keep = _carried(pages)
    shape = F.schema_of_variant(F.try_parse_json("data"))
    holds_null = F.exists(F.from_json("data", _STRINGS), lambda s: s.isNull())
    strings_only = (shape == "ARRAY<VOID>") | (shape == "ARRAY<STRING>")
    error = F.when(F.col("data").isNull(), "missing data field").when(
        ~F.coalesce(strings_only, F.lit(False)) | F.coalesce(holds_null, F.lit(False)),
        "data is not a list of symbols",
    )
    checked = pages.select(*keep, "data", error.alias("error"))
    listed = F.when(F.col("error").isNull(), F.from_json("data", _STRINGS)).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    return checked.select(*keep, F.explode(listed).alias("symbol"), "error")
