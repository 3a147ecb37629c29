"""Rolling totals over trailing periods, for every calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import day_number, usable
from tidemark.operators.bars_data import current_bars


def trailing_totals(daily: DataFrame, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """(source, day, age, total_N, count_N for each span N) for each day from a source's first to its last active one.

    daily: (source, day integer, total bigint, count bigint), one row per (source, day) with activity. age counts days
    from 1. Prefix sums per source are carried forward over the days up to the next active one; a trailing total is the
    difference between the prefix values at the ends of its window, exact in integers. Empty input gives no rows; rows
    with null source or day are left out.

    Scale: a source has at most one row per day here, whatever it had before, so a group is bounded by the calendar.
    """
    w = Window.partitionBy("source").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = daily.where("source is not null and day is not null").select(
        "source", F.col("day").cast("bigint").alias("day"), F.sum("total").over(upto).alias("p"), F.sum("count").over(upto).alias("c"),
        F.min("day").over(upto).cast("bigint").alias("first"), F.lead("day").over(w).cast("bigint").alias("nxt"),
    )
    dense = p.select("source", F.explode(F.sequence("day", F.coalesce(F.col("nxt") - 1, F.col("day")))).alias("day"), "p", "c", "first")
    w = Window.partitionBy("source").orderBy("day")
    cols = []
    for n in spans:
        cols.append((F.col("p") - F.coalesce(F.lag("p", n).over(w), F.lit(0))).alias(f"total_{n}"))
        cols.append((F.col("c") - F.coalesce(F.lag("c", n).over(w), F.lit(0))).alias(f"count_{n}"))
    return dense.select("source", "day", (F.col("day") - F.col("first") + 1).alias("age"), *cols)


def trailing_closes(etf: DataFrame, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing totals of the usable closes of the current bars, in whole cents. An infinite close has no cents and counts
    as unusable."""
    r = current_bars(etf, ["close"]).select(F.col("asset").alias("source"), day_number("bar_ts").alias("day"), F.round(usable("close") * 100).try_cast("bigint").alias("cents"))
    daily = r.where("day is not null and cents is not null").groupBy("source", "day").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("count"))
    return trailing_totals(daily, spans)
