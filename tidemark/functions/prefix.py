"""Running aggregates over ordered groups of any size.

A plain window over a group sorts the whole group in one task. Here a group is cut into blocks that follow the order: a
window runs inside each (group, block), one summary row per block is scanned over the group, and the carry is joined
back by (group, block). A group that holds a third of all rows so becomes as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_BLOCK = 50_000


def even_blocks(at: Column, low: int, high: int, rows: int) -> Column:
    """The block of a place between low and high: as many blocks of equal width as `rows` fill with ROWS_PER_BLOCK each, so that
    they get more, and not longer, as data grow."""
    return F.floor((at - low) / ((high - low) // max(1, -(-rows // ROWS_PER_BLOCK)) + 1)).cast("bigint")


def running(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with one column more for each entry of aggs.

    aggs: name -> (kind, expression); kind is 'sum' or 'max' (this row included), 'last' (last not-null value, this row
    included) or 'prev' (last not-null value before this row). block must not decrease along order. keys and block must
    not be null (rows with null there are dropped); order must be total for a defined result.
    """
    upto = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])  # plain numbers are aggregated by hash, structs after a sort
    df = df.dropna(subset=[*keys, block])
    local, totals, carried, out = df, [], [], {}
    for name, (kind, expr) in aggs.items():
        mine, theirs = f"__{name}_local", f"__{name}_carry"
        if kind == "sum":
            local = local.withColumn(mine, F.sum(expr).over(upto))
            totals.append(F.sum(expr).alias(theirs))
            carried.append(F.sum(theirs).over(blocks).alias(theirs))
            out[name] = F.coalesce(F.col(mine), F.lit(0)) + F.coalesce(F.col(theirs), F.lit(0))
        elif kind == "max":
            local = local.withColumn(mine, F.max(expr).over(upto))
            totals.append(F.max(expr).alias(theirs))
            carried.append(F.max(theirs).over(blocks).alias(theirs))
            out[name] = F.greatest(mine, theirs)
        else:
            local = local.withColumn(mine, F.last(expr, True).over(upto if kind == "last" else before))
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), place)).alias(theirs))
            carried.append(F.last(theirs, True).over(blocks).alias(theirs))
            out[name] = F.coalesce(F.col(mine), F.col(theirs))
    carry = df.groupBy(*keys, block).agg(*totals).select(*keys, block, *carried)
    return local.join(carry, [*keys, block]).select(*df.columns, *(c.alias(n) for n, c in out.items()))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """(keys, out): the exact median of value (nulls left out) of each group, halfway between the middle two if even. A null key
    is a key of its own.

    No group is collected: equal values are counted first, counts of logarithmic bins find the one or two bins that hold
    the middle ranks, and only the distinct values of these bins are ranked. The join takes null keys as equal, so that no
    filter is inferred for one of its sides and both read the same counts from one shuffle.
    """
    v = F.col(value)
    size = F.when(v == 0, F.lit(-100_000)).otherwise(F.floor(F.ln(F.abs(v)) * 64).cast("int"))
    counts = (
        df.where(v.isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bin", F.when(v < 0, F.lit(-200_000) - size).otherwise(size))
    )
    along = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)  # ranks from 0
    bins = (
        counts.groupBy(*keys, "__bin")
        .agg(F.sum("__n").alias("__bn"))
        .select(*keys, "__bin", (F.sum("__bn").over(along) - F.col("__bn")).alias("__below"), "__bn", F.sum("__bn").over(whole).alias("__all"))
        .where(((F.col("__below") <= low) & (low < F.col("__below") + F.col("__bn"))) | ((F.col("__below") <= high) & (high < F.col("__below") + F.col("__bn"))))
    )
    inside = Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__below") + F.sum("__n").over(inside)
    bins = bins.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bin").alias("__b"), "__below", "__all")
    alike = F.col("__bin").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        alike = alike & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = counts.join(bins, alike).select(*keys, v.alias("__v"), "__n", "__all", upto.alias("__upto"))
    hit = lambda r: (F.col("__upto") - F.col("__n") <= r) & (r < F.col("__upto"))
    return ranked.groupBy(*keys).agg(((F.max(F.when(hit(low), F.col("__v"))) + F.max(F.when(hit(high), F.col("__v")))) / 2).alias(out))
