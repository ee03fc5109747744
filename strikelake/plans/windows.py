"""Load windows: the date ranges still to fetch, and their split by row count."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions import side
from strikelake.operators.strikes import band_edges, close_by_day

# Days of history for a symbol without any, reach of a window back from its end,
# rows from which a window is too full, and the span in days that is not split any more.
HISTORY_DAYS, WINDOW_REACH, ROW_CAP, MIN_SPAN = 730, 30, 10_000, 1


def check_range(date_from: date | None, date_to: date | None) -> None:
    """An end needs a start, and the start comes first."""
    if date_to is not None and date_from is None:
        raise ValueError("an end without a start")
    if date_from is not None and date_to is not None and date_from > date_to:
        raise ValueError(f"the start {date_from} is later than the end {date_to}")


def load_spans(
    resume: DataFrame, as_of: date, date_from: date | None = None, date_to: date | None = None
) -> DataFrame:
    """Start and end of every load; a given start replaces the stored state.

    Without either, two years back from ``as_of``. A start after the end is up to date and left out.
    """
    check_range(date_from, date_to)
    history = F.date_sub(F.lit(as_of), HISTORY_DAYS)
    start = F.lit(date_from) if date_from else F.coalesce(F.col("resume_date"), history)
    spans = resume.select(
        "symbol", "option_type", start.alias("start"), F.lit(date_to or as_of).alias("end")
    )
    return spans.filter(F.col("start") <= F.col("end"))


def window_array(start: Column, end: Column) -> Column:
    """Windows of up to 31 days, anchored at the end, newest first."""
    length = WINDOW_REACH + 1
    count = F.floor(F.datediff(end, start) / length).cast("int")

    def window(i: Column) -> Column:
        to = F.date_sub(end, i * length)
        return F.struct(F.greatest(start, F.date_sub(to, WINDOW_REACH)).alias("from"), to.alias("to"))

    return F.when(start <= end, F.transform(F.sequence(F.lit(0), count), window))


def load_windows(
    resume: DataFrame, as_of: date, date_from: date | None = None, date_to: date | None = None
) -> DataFrame:
    """One row per symbol, side and window, numbered from the newest."""
    spans = load_spans(resume, as_of, date_from, date_to)
    return spans.select(
        "symbol",
        "option_type",
        F.posexplode(window_array(F.col("start"), F.col("end"))).alias("window_no", "_w"),
    ).select(
        "symbol",
        "option_type",
        "window_no",
        F.col("_w")["from"].alias("window_from"),
        F.col("_w")["to"].alias("window_to"),
    )


def side_day_counts(options: DataFrame) -> DataFrame:
    """Rows per symbol, side and day."""
    return (
        options.select(
            F.col("underlying_symbol").alias("symbol"),
            side(F.col("option_type")).alias("option_type"),
            F.col("quote_date").alias("date"),
        )
        .filter(F.col("option_type").isNotNull() & F.col("date").isNotNull())
        .groupBy("symbol", "option_type", "date")
        .agg(F.count("*").alias("n"))
    )


def strike_grid(options: DataFrame) -> DataFrame:
    """Per symbol, side and day the strikes in order, each with the rows up to and with it.

    Rows are added up per strike first, so what is gathered of a day are its distinct strikes. Rows
    without a strike are in no grid.
    """
    per_strike = (
        options.select(
            F.col("underlying_symbol").alias("symbol"),
            side(F.col("option_type")).alias("option_type"),
            F.col("quote_date").alias("date"),
            "strike",
        )
        .filter(F.col("option_type").isNotNull() & F.col("date").isNotNull() & (F.col("strike") < float("inf")))
        .groupBy("symbol", "option_type", "date", "strike")
        .agg(F.count("*").alias("n"))
    )
    of_day = Window.partitionBy("symbol", "option_type", "date").orderBy("strike")
    running = per_strike.withColumn("upto", F.sum("n").over(of_day))
    listed = F.array_sort(F.collect_list(F.struct("strike", "upto")))
    return running.groupBy("symbol", "option_type", "date").agg(listed.alias("grid"))


def _halve(node: Column) -> Column:
    """Two halves of a node; an odd day goes to the first."""
    middle = node["lo"] + F.floor((node["hi"] - node["lo"]) / 2).cast("int")
    return F.array(
        F.struct(node["lo"].alias("lo"), middle.alias("hi")),
        F.struct((middle + 1).alias("lo"), node["hi"].alias("hi")),
    )


def _rows_in(totals: Column, node: Column) -> Column:
    return F.get(totals, node["hi"] + 1) - F.get(totals, node["lo"])


def split_windows(
    spans: DataFrame,
    day_counts: DataFrame,
    prices: DataFrame | None = None,
    row_cap: int = ROW_CAP,
    grids: DataFrame | None = None,
    strike_halvings: int = 1,
) -> DataFrame:
    """Halve every window with more than ``row_cap`` rows until it fits or spans two days.

    ``spans`` are the loads of :func:`load_spans`, whose windows are those of :func:`load_windows`.
    ``outcome`` is ``fits``, ``incomplete`` (too full at the smallest span) or ``strike_band`` (a
    single day with a known close, which is split by strike instead: see the strike columns).

    With the ``grids`` of :func:`strike_grid` such a day is split on that axis too: ``strike_part`` is
    the ``lower`` or ``upper`` half of its band or what lies ``outside``, each with a range, rows and an
    outcome of its own. A half begins above ``strike_low`` (the lower one with it) and ends with
    ``strike_high``; while it is too full it is halved again, ``strike_halvings`` times in all.

    Both inputs are read once. Day counts are gathered by window, at most 31 each, ahead of anything
    else; they become running totals, an array of at most 32 numbers, and the halving is then
    arithmetic on one row, without a join or shuffle per level.
    """
    keys = ["symbol", "option_type", "window_no", "window_from", "window_to"]
    # Windows are numbered back from the end, so a day finds its window by arithmetic.
    number = F.floor(F.datediff("end", "date") / (WINDOW_REACH + 1)).cast("int")
    in_span = F.col("date").between(F.col("start"), F.col("end"))
    span_keys = ["symbol", "option_type", "start", "end"]
    held = (
        spans.select(*span_keys)
        .join(day_counts, ["symbol", "option_type"], "left")
        .groupBy(*span_keys, F.when(in_span, number).alias("no"))
        .agg(F.collect_list(F.when(in_span, F.struct("date", "n"))).alias("days"))
        .groupBy(*span_keys)
        .agg(
            F.map_from_entries(
                F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "days")))
            ).alias("_by_window")
        )
    )
    # Each window is handed its own days inside the array, so that no row carries those of all.
    dealt = F.transform(
        window_array(F.col("start"), F.col("end")),
        lambda w, i: F.struct(w.alias("w"), F.try_element_at("_by_window", i).alias("days")),
    )
    no_days = F.array().cast("array<struct<date:date,n:bigint>>")
    windows = held.select("symbol", "option_type", F.posexplode_outer(dealt).alias("window_no", "_d")).select(
        "symbol",
        "option_type",
        "window_no",
        F.col("_d.w")["from"].alias("window_from"),
        F.col("_d.w")["to"].alias("window_to"),
        F.coalesce("_d.days", no_days).alias("_days"),
    )
    span = F.datediff("window_to", "window_from")
    by_day = F.map_from_entries(
        F.transform(
            "_days",
            lambda day: F.struct(F.datediff(day["date"], "window_from").alias("day"), day["n"].alias("n")),
        )
    )
    none = F.lit(0).cast("bigint")
    # The map is the start of the fold, which is computed once; inside the fold's function it
    # would be computed again for every day.
    totals = F.aggregate(
        F.sequence(F.lit(0), span),
        F.struct(by_day.alias("by_day"), F.array(none).alias("totals")),
        lambda acc, i: F.struct(
            acc["by_day"].alias("by_day"),
            F.concat(
                acc["totals"],
                F.array(
                    F.element_at(acc["totals"], -1)
                    + F.coalesce(F.try_element_at(acc["by_day"], i), none)
                ),
            ).alias("totals"),
        ),
        lambda acc: acc["totals"],
    )
    nodes = windows.select(
        *keys,
        totals.alias("_totals"),
        F.array(F.struct(F.lit(0).alias("lo"), span.alias("hi"))).alias("_nodes"),
    )
    # A window of 31 days is down to two days after four halvings.
    for _ in range((WINDOW_REACH + 1).bit_length() - 1):
        nodes = nodes.withColumn(
            "_nodes",
            F.flatten(
                F.transform(
                    "_nodes",
                    lambda node: F.when(
                        (node["hi"] - node["lo"] > MIN_SPAN)
                        & (_rows_in(F.col("_totals"), node) > row_cap),
                        _halve(node),
                    ).otherwise(F.array(node)),
                )
            ),
        )
    # No window is without a node. The outer form spares a test for that, which would be computed
    # from the whole halving once more.
    leaves = nodes.select(*keys, "_totals", F.explode_outer("_nodes").alias("_n")).select(
        "symbol",
        "option_type",
        "window_no",
        F.date_add("window_from", F.col("_n")["lo"]).alias("load_from"),
        F.date_add("window_from", F.col("_n")["hi"]).alias("load_to"),
        _rows_in(F.col("_totals"), F.col("_n")).alias("n_rows"),
    )
    if grids is not None:
        return _by_strike_halves(leaves, prices, grids, row_cap, strike_halvings)
    return _by_strike(leaves, prices, row_cap)


def _by_strike_halves(
    leaves: DataFrame, prices: DataFrame | None, grids: DataFrame, row_cap: int, halvings: int
) -> DataFrame:
    """Leaves, those of a single day with a known close as parts of its strikes."""
    if prices is None:
        raise ValueError("a band needs prices")
    days = close_by_day(prices).withColumnRenamed("date", "load_from")
    single = F.col("load_from") == F.col("load_to")
    met = leaves.join(days, ["symbol", "load_from"], "left").join(
        grids.withColumnRenamed("date", "load_from"), ["symbol", "option_type", "load_from"], "left"
    )
    low, mid, high = band_edges(F.col("close"))
    no_grid = F.array().cast("array<struct<strike:double,upto:bigint>>")

    def upto(edge: Column, with_edge: Column) -> Column:
        reached = F.filter(
            F.coalesce("grid", no_grid), lambda g: (g["strike"] < edge) | (with_edge & (g["strike"] == edge))
        )
        return F.coalesce(F.try_element_at(reached, F.lit(-1))["upto"], F.lit(0).cast("bigint"))

    def part(name: Column, lo: Column, hi: Column, closed: Column) -> Column:
        n = upto(hi, F.lit(True)) - upto(lo, ~closed)
        return F.struct(name.alias("part"), lo.alias("lo"), hi.alias("hi"), closed.alias("closed"), n.alias("n"))

    def halved(node: Column) -> Column:
        middle = (node["lo"] + node["hi"]) / 2
        both = F.array(
            part(node["part"], node["lo"], middle, node["closed"]), part(node["part"], middle, node["hi"], F.lit(False))
        )
        return F.when((node["n"] > row_cap) & (node["lo"] < middle) & (middle < node["hi"]), both).otherwise(F.array(node))

    banded = single & F.col("close").isNotNull()
    halves = F.array(
        part(F.lit("lower"), low, mid, F.lit(True)), part(F.lit("upper"), mid, high, F.lit(False))
    )
    nodes = met.withColumn("_nodes", F.when(banded, halves))
    nodes = nodes.withColumn(
        "_rest", F.col("n_rows") - F.aggregate("_nodes", F.lit(0).cast("bigint"), lambda total, x: total + x["n"])
    )
    for _ in range(halvings - 1):
        nodes = nodes.withColumn("_nodes", F.flatten(F.transform("_nodes", halved)))
    none = F.lit(None).cast("double")
    kind = "struct<part:string,lo:double,hi:double,closed:boolean,n:bigint>"
    outside = F.struct(F.lit("outside"), none, none, F.lit(False), F.col("_rest")).cast(kind)
    whole = F.array(F.struct(F.lit(None), none, none, F.lit(False), F.col("n_rows")).cast(kind))
    every = F.coalesce(F.concat("_nodes", F.array(outside)), whole)
    return nodes.select(*[c for c in leaves.columns if c != "n_rows"], F.explode(every).alias("_n")).select(
        *[c for c in leaves.columns if c != "n_rows"],
        F.col("_n.part").alias("strike_part"),
        F.col("_n.lo").alias("strike_low"),
        F.col("_n.hi").alias("strike_high"),
        F.col("_n.n").alias("n_rows"),
        F.when(F.col("_n.n") > row_cap, "incomplete").otherwise("fits").alias("outcome"),
    )


def _by_strike(leaves: DataFrame, prices: DataFrame | None, row_cap: int) -> DataFrame:
    too_full = F.when(F.col("n_rows") > row_cap, "incomplete").otherwise("fits")
    if prices is None:
        empty = F.lit(None).cast("double")
        return leaves.withColumns(
            {"outcome": too_full, "strike_low": empty, "strike_mid": empty, "strike_high": empty}
        )
    closes = close_by_day(prices).withColumnRenamed("date", "load_from")
    single = F.col("load_from") == F.col("load_to")
    banded = single & F.col("close").isNotNull()
    low, mid, high = band_edges(F.col("close"))
    return (
        leaves.join(closes, ["symbol", "load_from"], "left")
        .withColumns(
            {
                "outcome": F.when(banded, "strike_band").otherwise(too_full),
                "strike_low": F.when(banded, low),
                "strike_mid": F.when(banded, mid),
                "strike_high": F.when(banded, high),
            }
        )
        .select(*leaves.columns, "outcome", "strike_low", "strike_mid", "strike_high")
    )
