"""Window expressions over ordered bars.

keys name the partition: ["asset"], or with a scenario key more (fold, cut, perm_id, strategy). Every helper takes them, so a
rule written once runs over any set of scenarios in one plan. Missing values are null; a full-window statistic is null until
its window is full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]
EPS = 1e-9  # thresholds are compared beyond the noise of summation order


def over(keys: Keys, order: str = "bar") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys: Keys, n: int, order: str = "bar") -> WindowSpec:
    return over(keys, order).rowsBetween(-(n - 1), 0)


def upto(keys: Keys, order: str = "bar") -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c: Column | str, keys: Keys, k: int = 1) -> Column:
    return F.lag(c, k).over(over(keys)) if k >= 0 else F.lead(c, -k).over(over(keys))


def change(c: Column | str, keys: Keys, k: int = 1) -> Column:
    """c / c k bars before, minus 1; null where there is none."""
    return F.try_divide(col(c), lag(c, keys, k)) - 1


def bar_return(c: Column | str, keys: Keys) -> Column:
    """Simple return, 0 on the first bar."""
    return F.coalesce(change(c, keys), F.lit(0.0))


def rolling(fn, c: Column | str, n: int, keys: Keys) -> Column:
    """fn over the last n bars, null unless all n values are there."""
    w = trailing(keys, n)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def roll_mean(c, n, keys):
    return rolling(F.avg, c, n, keys)


def roll_std(c, n, keys):
    return rolling(F.stddev_samp, c, n, keys)


def roll_var(c, n, keys):
    return rolling(F.var_samp, c, n, keys)


def roll_max(c, n, keys):
    return rolling(F.max, c, n, keys)


def roll_min(c, n, keys):
    return rolling(F.min, c, n, keys)


def above(a: Column, b: Column) -> Column:
    """a > b, false where either is missing."""
    return F.coalesce(a - b > EPS, F.lit(False))


def below(a: Column, b: Column) -> Column:
    return above(b, a)


def hold(c: Column, keys: Keys) -> Column:
    """The last not-null value so far."""
    return F.last(c, ignorenulls=True).over(upto(keys))


def latch(enter: Column, leave: Column, keys: Keys) -> Column:
    """1 from enter until leave, else 0; enter wins where both hold."""
    return F.coalesce(hold(F.when(enter, 1.0).when(leave, 0.0), keys), F.lit(0.0))


def fold_of(n: Column, folds: int, bar: Column | str = "bar") -> Column:
    """Equal folds by bar; the last one takes the remainder, so it takes all of less bars than folds."""
    return F.coalesce(F.least(F.floor(F.try_divide(col(bar), F.floor(n / folds))), F.lit(folds - 1)), F.lit(folds - 1)).cast("int")


def sign(c: Column) -> Column:
    return F.signum(F.when(F.abs(c) > 1e-12, c).otherwise(F.when(c.isNotNull(), 0.0)))


BLOCK = 256


def decay_sum(df: DataFrame, keys: Keys, x: str, alpha: float, out: str) -> DataFrame:
    """df with out = sum over i <= t of (1 - alpha)^(t - i) * x_i, by bar (0, 1, 2, ... without gaps, x not null).

    The recursion is scanned in blocks of BLOCK bars: within a block a window sum of x scaled by (1 - alpha)^-position
    gives the local part, the carry comes from the ends of the blocks before: from those that double precision sees or, where
    these are more than 64, from the same scan over the blocks. No Python, and no task longer than a block of one key.
    """
    q = 1.0 - alpha
    back = 1
    while q ** (BLOCK * back) > 1e-22 and back < 64:
        back += 1
    if q**-BLOCK > 1e250:
        raise ValueError("alpha is too large for BLOCK")
    df = df.withColumns({"__block": F.floor(F.col("bar") / BLOCK), "__at": F.col("bar") % BLOCK})
    local = F.sum(F.col(x) * F.pow(F.lit(q), -F.col("__at"))).over(Window.partitionBy(*keys, "__block").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(q), F.col("__at"))
    ends = df.groupBy(*keys, "__block").agg((F.sum(F.col(x) * F.pow(F.lit(q), -F.col("__at"))) * q ** (BLOCK - 1)).alias("__end"))
    w = Window.partitionBy(*keys).orderBy("__block")
    if q ** (BLOCK * back) > 1e-22:
        ends = decay_sum(ends.withColumnRenamed("__block", "bar"), keys, "__end", 1.0 - q**BLOCK, "__sum").withColumnRenamed("bar", "__block")
        carry = F.coalesce(F.lag("__sum", 1).over(w), F.lit(0.0))
    else:
        carry = sum((F.coalesce(F.lag("__end", m).over(w), F.lit(0.0)) * q ** (BLOCK * (m - 1)) for m in range(2, back + 1)), F.coalesce(F.lag("__end", 1).over(w), F.lit(0.0)))
    ends = ends.select(*keys, "__block", carry.alias("__carry"))
    whole = F.col("__local") + F.col("__carry") * F.pow(F.lit(q), F.col("__at") + 1)
    return df.withColumn("__local", local).join(ends, [*keys, "__block"]).withColumn(out, whole).drop("__block", "__at", "__local", "__carry")


def ewm_mean(df: DataFrame, keys: Keys, x: str, span: int, out: str, adjust: bool = False) -> DataFrame:
    """Exponentially weighted mean; adjust=False is the recursion from the first value, adjust=True divides by the weights."""
    a = 2.0 / (span + 1)
    q = 1.0 - a
    df = decay_sum(df, keys, x, a, "__s")
    if adjust:
        return df.withColumn(out, F.col("__s") * a / (1 - F.pow(F.lit(q), F.col("bar") + 1))).drop("__s")
    first = F.first(x).over(upto(keys))
    return df.withColumn(out, F.col("__s") * a + F.pow(F.lit(q), F.col("bar") + 1) * first).drop("__s")


def blockwise(rule, lookback: int, block: int = 4096, ahead: int = 0):
    """rule (df, keys) -> df as the same rule over blocks of `block` bars of each key.

    For rules whose value at a bar depends on at most `lookback` bars before it and `ahead` after it, and not on bar's own
    number. Each block takes the bars of its neighbours that it needs and drops them again, so a key with a third of all
    bars becomes many tasks. The column bar must be 0, 1, 2, ... within a key.
    """
    if not 0 <= max(lookback, ahead) <= block:
        raise ValueError("a block must hold the look-back")

    def run(df: DataFrame, keys: Keys) -> DataFrame:
        own, at = F.floor(F.col("bar") / block), F.col("bar") % block
        homes = F.array_compact(F.array(own, F.when(at >= block - lookback, own + 1), F.when((at < ahead) & (own > 0), own - 1)))
        out = rule(df.withColumn("__block", F.explode(homes)), [*keys, "__block"])
        return out.where(F.floor(F.col("bar") / block) == F.col("__block")).drop("__block")

    return run
