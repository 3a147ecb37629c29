"""Position rules: (bars, keys) -> bars with a column position, held into the next bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Keys, above, below, change, ewm_mean, lag, latch, over, roll_max, roll_mean, roll_min, roll_std, sign

Strategy = Callable[[DataFrame, Keys], DataFrame]


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def rsi(keys: Keys, n: int = 14, price: str = "close") -> Column:
    """Relative strength from simple means of the last n ups and downs; a price change must be a column __d."""
    up = roll_mean(F.greatest("__d", F.when(F.col("__d").isNotNull(), 0.0)), n, keys)
    down = roll_mean(F.greatest(-F.col("__d"), F.when(F.col("__d").isNotNull(), 0.0)), n, keys)
    return 100 - 100 / (1 + up / (down + 1e-12))


def with_rsi(df: DataFrame, keys: Keys, n: int = 14, out: str = "rsi") -> DataFrame:
    return df.withColumn("__d", F.col("close") - lag("close", keys)).withColumn(out, rsi(keys, n)).drop("__d")


def macd(df: DataFrame, keys: Keys, adjust: bool = False) -> DataFrame:
    """Long while the difference of 12- and 26-bar means is above its 9-bar mean and the close above its 200-bar mean."""
    df = ewm_mean(ewm_mean(df, keys, "close", 12, "__fast", adjust), keys, "close", 26, "__slow", adjust)
    df = ewm_mean(df.withColumn("__line", F.col("__fast") - F.col("__slow")), keys, "__line", 9, "__signal", adjust)
    rule = above(F.col("__line"), F.col("__signal")) & above(F.col("close"), roll_mean("close", 200, keys))
    return df.withColumn("position", flag(rule)).drop("__fast", "__slow", "__line", "__signal")


def macd_adjusted(df: DataFrame, keys: Keys) -> DataFrame:
    return macd(df, keys, adjust=True)


def rsi_reversion(df: DataFrame, keys: Keys) -> DataFrame:
    """Long from RSI under 30 until it is over 50."""
    df = with_rsi(df, keys, 14, "__rsi")
    return df.withColumn("position", latch(below(F.col("__rsi"), F.lit(30.0)), above(F.col("__rsi"), F.lit(50.0)), keys)).drop("__rsi")


def donchian(df: DataFrame, keys: Keys, n: int = 50) -> DataFrame:
    """Long from a close at the n-bar high until one at the n-bar low; this bar belongs to the channel."""
    df = df.withColumns({"__hi": roll_max("close", n, keys), "__lo": roll_min("close", n, keys)})
    return df.withColumn("position", latch(F.col("close") >= F.col("__hi"), F.col("close") <= F.col("__lo"), keys)).drop("__hi", "__lo")


def reversal(df: DataFrame, keys: Keys, n: int = 5) -> DataFrame:
    return df.withColumn("position", F.coalesce(-sign(change("close", keys, n)), F.lit(0.0)))


def gap_fade(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("position", F.coalesce(-sign(F.try_divide(F.col("open"), lag("close", keys)) - 1), F.lit(0.0)))


def trend(df: DataFrame, keys: Keys, n: int = 100) -> DataFrame:
    return df.withColumn("position", flag(above(F.col("close"), roll_mean("close", n, keys))))


def momentum(df: DataFrame, keys: Keys, n: int = 252) -> DataFrame:
    return df.withColumn("position", flag(above(change("close", keys, n), F.lit(0.0))))


def turn_of_month(df: DataFrame, keys: Keys, last: int = 3, first: int = 2) -> DataFrame:
    """Long on the first and last bars of each month. The last bars are known only afterwards: the audit flags this rule."""
    month = F.trunc("day", "MM")
    w = Window.partitionBy(*keys, month)
    ends = (F.row_number().over(w.orderBy("bar")) <= first) | (F.row_number().over(w.orderBy(F.desc("bar"))) <= last)
    return df.withColumn("position", flag(ends))


def winter(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("position", flag(F.month("day").isin(11, 12, 1, 2, 3, 4)))


def mid_week(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("position", flag(F.weekday("day").isin(1, 2, 3)))


def always_long(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("position", F.lit(1.0))


def after_down(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("position", flag(below(F.col("close"), lag("close", keys))))


def arbitrary(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("position", flag(F.pmod(F.floor(F.col("close") * 100), F.lit(7)) >= 4))


def sma20(df: DataFrame, keys: Keys) -> DataFrame:
    return trend(df, keys, 20)


def peek(df: DataFrame, keys: Keys) -> DataFrame:
    """A planted leak: looks at the next close."""
    return df.withColumn("position", flag(above(lag("close", keys, -1), F.col("close"))))


def centred(df: DataFrame, keys: Keys) -> DataFrame:
    """A planted leak: a 20-bar mean around the bar."""
    w = over(keys).rowsBetween(-10, 9)
    return df.withColumn("position", flag(above(F.col("close"), F.when(F.count("close").over(w) == 20, F.avg("close").over(w)))))


def spread_reversion(df: DataFrame, keys: Keys, n: int = 30, entry: float = 2.0) -> DataFrame:
    """Against a log spread more than `entry` deviations from its n-bar mean."""
    z = F.try_divide(F.col("spread") - roll_mean("spread", n, keys), roll_std("spread", n, keys))
    df = df.withColumn("__z", z)
    return df.withColumn("position", F.when(above(F.col("__z"), F.lit(entry)), -1.0).when(below(F.col("__z"), F.lit(-entry)), 1.0).otherwise(0.0)).drop("__z")


REGISTRY: dict[str, Strategy] = {
    "macd_200": macd_adjusted, "rsi_reversion": rsi_reversion, "donchian_50": donchian, "reversal_5": reversal, "gap_fade": gap_fade, "trend_100": trend,
}


def grid(bars: DataFrame, keys: Keys = ("asset",), registry: dict[str, Strategy] = REGISTRY) -> DataFrame:
    """All strategies over all assets: (strategy, keys, bar, close, position)."""
    out = None
    for name, rule in registry.items():
        one = rule(bars, list(keys)).select(F.lit(name).alias("strategy"), *keys, "bar", "close", "position")
        out = one if out is None else out.unionByName(one)
    return out


def from_pandas(rule: Callable, schema_of: Callable[[DataFrame], str]) -> Strategy:
    """A rule over a pandas frame of one key's bars as a Strategy; for rules that no expression can state."""

    def run(df: DataFrame, keys: Keys) -> DataFrame:
        return df.groupBy(*keys).applyInPandas(lambda pdf: (p := pdf.sort_values("bar")).assign(position=rule(p)), schema_of(df))

    return run
