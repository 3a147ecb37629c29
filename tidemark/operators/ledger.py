"""Ledger of trials and corrections for their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, ts timestamp, name string, p_value double, total_return double, extra map<string,string>"


def log_trials(trials: DataFrame, path: str, run_id: str = "default") -> None:
    """Append trials (name, p_value, total_return[, extra]) as JSON lines."""
    extra = F.col("extra").cast("map<string,string>") if "extra" in trials.columns else F.lit(None).cast("map<string,string>")
    trials.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ts"), "name", "p_value", "total_return", extra.alias("extra")).write.mode("append").json(path)


def load_trials(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The trials of the ledger, of one run or of all; none if there is no ledger yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    df = spark.read.schema(SCHEMA).json(path) if there else spark.createDataFrame([], SCHEMA)
    return df.where(F.col("run_id") == run_id) if run_id is not None else df


def bonferroni(n: int, alpha: float = 0.05) -> float:
    return alpha / max(n, 1)


def assess(trials: DataFrame, alpha: float = 0.05, naive: float = 0.01) -> DataFrame:
    """One row: trials, bars, expected false positives, passes of either bar and the survivors by p value."""
    n, p = F.count(F.lit(1)), F.col("p_value")
    found = trials.agg(n.alias("n_trials"), F.count(F.when(p < naive, 1)).alias("naive_passes"), F.collect_list(F.when(p < alpha, F.struct("p_value", "name"))).alias("s"))
    bar = F.lit(alpha) / F.greatest(F.col("n_trials"), F.lit(1))  # at most alpha: every survivor is in s
    out = found.withColumn("corrected_bar", bar).withColumn("s", F.array_sort(F.filter("s", lambda x: x["p_value"] < F.col("corrected_bar"))))
    return out.select("n_trials", "corrected_bar", (F.col("n_trials") * naive).alias("expected_false"), "naive_passes", F.size("s").alias("corrected_passes"), F.concat_ws(",", F.transform("s", lambda x: x["name"])).alias("survivors"))
