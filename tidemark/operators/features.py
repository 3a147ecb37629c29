"""Features and targets of a direction model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import Keys, change, lag, roll_mean, roll_std
from tidemark.operators.strategies import with_rsi

FEATURES = ("ret_1", "ret_5", "ret_20", "vol_norm", "mom_norm", "rsi", "range_norm", "dist_ma", "gap_norm")


def build_features(df: DataFrame, keys: Keys) -> DataFrame:
    """df with FEATURES, null while a window isn't full."""
    df = df.withColumns({"ret_1": change("close", keys), "ret_5": change("close", keys, 5), "ret_20": change("close", keys, 20), "__ret_50": change("close", keys, 50)})
    df = df.withColumns({"__vol": roll_std("ret_1", 20, keys), "__range": F.try_divide(F.col("high") - F.col("low"), F.col("close")), "__ma": roll_mean("close", 50, keys)})
    df = df.withColumns({"__usual_vol": roll_mean("__vol", 252, keys), "__usual_range": roll_mean("__range", 20, keys)})
    df = df.withColumns({
        "vol_norm": F.try_divide("__vol", "__usual_vol"),
        "mom_norm": F.col("__ret_50") / (F.col("__vol") * 50**0.5 + 1e-12),
        "range_norm": F.col("__range") / (F.col("__usual_range") + 1e-12),
        "dist_ma": F.try_divide(F.col("close") - F.col("__ma"), F.col("close")),
        "gap_norm": (F.try_divide(F.col("open"), lag("close", keys)) - 1) / (F.col("__vol") + 1e-12),
    })
    df = with_rsi(df, keys).withColumn("rsi", F.col("rsi") / 100)
    return df.drop("__vol", "__range", "__ma", "__usual_vol", "__usual_range", "__ret_50")


def make_target(df: DataFrame, keys: Keys, horizon: int = 1, keep_tail: bool = False) -> DataFrame:
    """df with target: 1 if the close in `horizon` bars is higher, else 0; the last bars have none (0 with keep_tail)."""
    ahead = lag("close", keys, -horizon)
    tail = F.lit(0) if keep_tail else F.lit(None).cast("int")
    return df.withColumn("target", F.when(ahead.isNull(), tail).otherwise((ahead > F.col("close")).cast("int")))


def feature_matrix(df: DataFrame, keys: Keys, horizon: int = 1) -> DataFrame:
    return make_target(build_features(df, keys), keys, horizon).dropna(subset=[*FEATURES, "target"])
