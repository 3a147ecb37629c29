"""The best N items of every group, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import genuine_pe, norm_key, number, round4
from tidemark.session import cut

#: Groups whose bounds are sent to all tasks at once at most.
BROADCAST_GROUPS = 500_000


def top_n(df: DataFrame, group: str, item: str, score: Sequence[Column], n: int) -> DataFrame:
    """(group, item, rank) of the first n items of each group, best first.

    score: columns, more important first, the greater the better, nulls last; ties go to the smaller item. Copies of an
    item (same group and item) count once, with their best score. Rows with null group or item are left out; a group with
    fewer items keeps all. Empty input gives no rows.

    Each input partition keeps the rows of its n best scores per group. Of these rows, reduced to each item's best score, the
    n-th best item is a lower bound of the group's n-th best, whatever else the group holds; with less than n items there is
    no bound. The bounds, one row per group at most, are written and counted: up to BROADCAST_GROUPS are broadcast to the scan
    of the rows, so that only survivors are shuffled; more of them are joined by a shuffle, whose hot groups AQE splits. The
    local ranks and the last one are group-limited before their shuffle (WindowGroupLimit).
    """
    key = F.struct(*(F.struct(c.isNotNull(), c) for c in score), -F.col(item))
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), key.alias("s"))
    local = rows.select("g", "i", "s", F.spark_partition_id().alias("p"))
    local = local.withColumn("r", F.dense_rank().over(Window.partitionBy("g", "p").orderBy(F.desc("s")))).where(F.col("r") <= n)
    tops = local.groupBy("g", "i").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"))))
    bounds = cut(tops.where(F.col("r") == n).select("g", F.col("s").alias("bound")))
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds
    survivors = rows.join(bounds, "g", "left").where(F.col("bound").isNull() | (F.col("s") >= F.col("bound")))
    items = survivors.groupBy("g", "i").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s")))
    return items.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(item), "rank")


def best_filings(fundamentals: DataFrame, n: int = 5) -> DataFrame:
    """(ticker, filing_id, rank): per ticker the n filings with the best roe (4 decimals), then the greatest gross_margin,
    then the smallest genuine pe, then the smallest filing_id; missing gross_margin and pe come last, filings without roe
    are left out."""
    f = fundamentals.select(norm_key("ticker").alias("ticker"), "filing_id", round4("roe").alias("roe"), number("gross_margin").alias("gm"), genuine_pe().alias("pe")).where("roe is not null")
    return top_n(f, "ticker", "filing_id", [F.col("roe"), F.col("gm"), -F.col("pe")], n)
