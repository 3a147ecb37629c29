"""Calibration of probability forecasts (prob, outcome)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metrics import brier, finite


def both(df: DataFrame) -> DataFrame:
    """Rows with a finite forecast and outcome; one mask for every score."""
    return df.select(finite("prob").alias("prob"), finite("outcome").alias("outcome")).where("prob is not null and outcome is not null")


def bin_of(p: Column, n_bins: int) -> Column:
    """Bin of p among equal bins of [0, 1]: [lo, hi), the last one closed; null outside. Edges are the doubles i / n_bins:
    the product's bin is moved by one where rounding put it on the wrong side of an edge."""
    k = F.floor(p * n_bins)
    k = F.when(p < k / n_bins, k - 1).when(p >= (k + 1) / n_bins, k + 1).otherwise(k)
    return F.when((p >= 0) & (p <= 1), F.least(k, F.lit(n_bins - 1)).cast("int"))


def reliability(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n, mean_prob, freq): every bin, empty ones with n = 0."""
    got = both(df).withColumn("bin", bin_of(F.col("prob"), n_bins)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.avg("outcome").alias("freq"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / n_bins).alias("lo"), ((F.col("id") + 1) / n_bins).alias("hi"))
    return bins.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def murphy(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: reliability, resolution, uncertainty, base_rate, recombined, ece, over the binned forecasts."""
    b = both(df).withColumn("bin", bin_of(F.col("prob"), n_bins)).where("bin is not null")
    per = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("p"), F.avg("outcome").alias("o"), F.sum("outcome").alias("s"))
    total = per.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("base"), F.collect_list(F.struct("n", "p", "o")).alias("bins"))  # at most n_bins

    def mean(f) -> Column:
        return F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + x["n"] * f(x)) / F.col("n")

    t = total.where("n > 0").select(
        "n", F.col("base").alias("base_rate"), mean(lambda x: F.pow(x["p"] - x["o"], 2)).alias("reliability"), mean(lambda x: F.pow(x["o"] - F.col("base"), 2)).alias("resolution"),
        (F.col("base") * (1 - F.col("base"))).alias("uncertainty"), mean(lambda x: F.abs(x["p"] - x["o"])).alias("ece"),
    )
    return t.withColumn("recombined", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def expected_calibration_error(df: DataFrame, n_bins: int = 10) -> DataFrame:
    return murphy(df, n_bins).select("ece")


def calibration_report(df: DataFrame, n_bins: int = 10, label: str = "") -> DataFrame:
    """One row: the Murphy parts, the Brier score, that of always forecasting the base rate, and the skill over it."""
    scores = both(df).agg(brier("prob", "outcome").alias("brier"), F.var_pop("outcome").alias("brier_base"), F.lit(1).alias("one"))
    out = murphy(df, n_bins).withColumn("one", F.lit(1)).join(scores, "one").drop("one")
    return out.select(F.lit(label).alias("label"), "*", (1 - F.try_divide("brier", "brier_base")).alias("skill"))


def useful(report: DataFrame, skill: float = 0.01, resolution: float = 1e-3) -> DataFrame:
    """report of calibration_report with survives: skill over the base rate and resolution both above their least."""
    return report.withColumn("survives", F.coalesce((F.col("skill") > skill) & (F.col("resolution") > resolution), F.lit(False)))
