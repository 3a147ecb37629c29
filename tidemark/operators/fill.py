"""Filling missing values from similar records, by hierarchical group statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import genuine_cap, genuine_date, genuine_pe, norm_key
from tidemark.functions.prefix import exact_median
from tidemark.operators.filings import distinct_filings
from tidemark.session import cut


@dataclass(frozen=True)
class Level:
    """A grouping, from fine to coarse; a group counts if it holds at least support values."""

    name: str
    keys: tuple[str, ...]
    support: int


#: Groups whose statistics are sent to all tasks at once at most; more of them are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def fill_missing(df: DataFrame, row_id: str, numeric: Sequence[str], categorical: Sequence[str], levels: Sequence[Level]) -> DataFrame:
    """One row per missing value: (row_id, field, filled string, level, support).

    Null is missing (map placeholders and NaN to null first). A numeric field takes the exact median of the finest group with
    enough support (halfway between the middle two), a categorical one its mode (ties: the value that sorts first). Values
    travel as strings, so that all fields share one result; level is null and filled null if no level has support. row_id is
    unique. Empty input gives no rows; a null in a grouping column means that the row takes no part in that level.

    Scale: values are counted per combination of all grouping columns first and the counts rolled up to the levels; each missing
    value then picks its level by one equi-join, whose hot keys AQE splits. Statistics are made for the picked groups only:
    these are counted and, up to BROADCAST_GROUPS, broadcast to the scan of the values, beyond that joined by a shuffle.
    Medians are exact at every size (functions.prefix), so a group with a third of all rows is spread over its values.
    """
    keys = list(dict.fromkeys(k for lv in levels for k in lv.keys))
    fields = [*numeric, *categorical]
    df = cut(df.select(*dict.fromkeys([row_id, *keys, *fields])))  # read for counts, missing values, numbers and categories

    def key_of(i: int, lv: Level) -> Column:
        """The level's number and the length-prefixed keys, so that different groups never meet; null if a part is null."""
        parts = [F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in lv.keys]
        return F.concat(F.lit(f"{i}|"), *parts)

    groups = F.explode(F.array_compact(F.array(*(F.when(key_of(i, lv).isNotNull(), F.struct(F.lit(i).alias("level"), key_of(i, lv).alias("key"))) for i, lv in enumerate(levels))))).alias("g")
    count_of = {c: f"__n{i}" for i, c in enumerate(fields)}
    finest = df.groupBy(*keys).agg(*(F.count(c).alias(n) for c, n in count_of.items()))
    support = finest.select(groups, *count_of.values()).groupBy("g.key").agg(*(F.sum(n).alias(n) for n in count_of.values()))

    missing = F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in fields))))
    wanted = df.select(row_id, *keys, missing.alias("field")).select(row_id, "field", groups).select(row_id, "field", "g.level", "g.key")
    n = F.coalesce(*(F.when(F.col("field") == c, F.col(v)) for c, v in count_of.items()))
    least = F.element_at(F.array(*(F.lit(lv.support) for lv in levels)), F.col("level") + 1)
    found = wanted.join(support, "key", "left").withColumn("n", n)
    best = found.groupBy(row_id, "field").agg(F.min(F.when(F.col("n") >= least, F.struct("level", "key", "n"))).alias("b"))
    picked = cut(best.select(row_id, "field", "b.level", "b.key", "b.n"))

    chosen = cut(picked.where("key is not null").groupBy("key").agg(*(F.max((F.col("field") == c).cast("int")).alias(v) for c, v in count_of.items())))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_GROUPS else chosen
    stats = []
    if numeric:
        one = F.explode(F.array_compact(F.array(*(F.when((F.col(count_of[c]) == 1) & F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x"))) for c in numeric))))
        values = df.select(groups, *numeric).select("g.key", *numeric).join(chosen, "key").select("key", one.alias("o")).select("key", "o.field", "o.x")
        stats.append(exact_median(values, ["key", "field"], "x", "value").withColumn("value", F.col("value").cast("string")))
    for c in categorical:
        pairs = df.where(F.col(c).isNotNull()).groupBy(*dict.fromkeys([*keys, c])).agg(F.count(F.lit(1)).alias("__n"))
        pairs = pairs.select(F.col(c).cast("string").alias("value"), "__n", groups).select("value", "__n", "g.key").join(chosen.where(F.col(count_of[c]) == 1).select("key"), "key")
        counted = pairs.groupBy("key", "value").agg(F.sum("__n").alias("n"))
        mode = counted.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best"))
        stats.append(mode.select("key", F.lit(c).alias("field"), F.col("best.value").alias("value")))
    table = stats[0]
    for s in stats[1:]:
        table = table.unionByName(s)
    names = F.array(*(F.lit(lv.name) for lv in levels))
    # element_at of a null position isn't null in Spark 4.1.2 but the last element, so the null case is stated
    level = F.when(F.col("level").isNotNull(), F.element_at(names, F.col("level") + 1))
    return picked.join(table, ["key", "field"], "left").select(row_id, "field", F.col("value").alias("filled"), level.alias("level"), F.col("n").alias("support"))


#: From the ticker's own filings of the period, year and all time, then from the sector and the market of the same period, then from all.
FILING_LEVELS = (
    Level("ticker_period", ("ticker", "fiscal_period"), 3),
    Level("ticker_year", ("ticker", "fiscal_year"), 3),
    Level("ticker", ("ticker",), 1),
    Level("sector_period", ("sector", "fiscal_period"), 5),
    Level("period", ("fiscal_period",), 1),
    Level("all", (), 1),
)
TICKER_LEVELS = ("ticker_period", "ticker_year", "ticker")


def filings_with_gaps(fundamentals: DataFrame, sectors: DataFrame) -> DataFrame:
    """Distinct filings with market_cap, pe, date_filed (as day number) and sector (as sectors names it), null where not genuine."""
    known = F.broadcast(sectors.select(norm_key("sector_name").alias("__sector"), "sector_name").where("__sector is not null").groupBy("__sector").agg(F.min("sector_name").alias("sector_name")))  # a dimension of 12 rows
    f = distinct_filings(fundamentals, ["date_filed", "sector", "fiscal_period", "pe", "market_cap"])
    return f.join(known, norm_key("sector") == F.col("__sector"), "left").select(
        "filing_id", "ticker", "fiscal_period", F.substring("fiscal_period", 1, 4).alias("fiscal_year"),
        F.col("sector_name").alias("sector"), genuine_pe().alias("pe"), genuine_cap().alias("market_cap"), F.unix_date(genuine_date()).alias("date_filed"),
    )


def fill_filings(fundamentals: DataFrame, sectors: DataFrame) -> DataFrame:
    """The filled values of all filings, marked: (filing_id, field, filled, level, support); dates as 'yyyy-MM-dd'.

    A ticker's median date over all time would be a poor date, yet it is the ticker's own; period and year come first.
    """
    out = fill_missing(filings_with_gaps(fundamentals, sectors), "filing_id", ["market_cap", "pe", "date_filed"], ["sector"], FILING_LEVELS)
    day = F.date_from_unix_date(F.round(F.col("filled").try_cast("double")).cast("int")).cast("string")
    return out.withColumn("filled", F.when(F.col("field") == "date_filed", day).otherwise(F.col("filled")))
