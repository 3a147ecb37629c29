"""Correlation structure: realised correlation, its regimes and lead, hierarchical risk parity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import bar_return, lag, over, roll_var

KEY = ["asset"]


def realized_correlation(panel: DataFrame, n: int = 21) -> DataFrame:
    """(bar, rho): average correlation implied by the variance of the mean return against the mean variance, in [0, 1]."""
    d = panel.withColumn("__r", bar_return("close", KEY)).withColumn("__v", roll_var("__r", n, KEY))
    by_bar = d.groupBy("bar").agg(F.avg("__r").alias("index_ret"), F.avg("__v").alias("avg_var"), F.count("__r").alias("m")).withColumn("one", F.lit(1))
    raw = (F.try_divide(roll_var("index_ret", n, ["one"]), F.col("avg_var")) - 1 / F.col("m")) / F.try_subtract(F.lit(1.0), 1 / F.col("m"))
    d = by_bar.where("m > 1").withColumn("__rho", raw)
    return d.select("bar", F.when(F.col("__rho").isNotNull(), F.least(F.greatest("__rho", F.lit(0.0)), F.lit(1.0))).alias("rho"))


def correlation_regime(rho: DataFrame, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """rho with regime by the terciles of the whole sample (for analysis: not causal)."""
    q = rho.agg(F.percentile("rho", F.lit(low)).alias("lo"), F.percentile("rho", F.lit(high)).alias("hi"), F.lit(1).alias("one"))
    d = rho.withColumn("one", F.lit(1)).join(F.broadcast(q), "one")  # one row
    label = F.when(F.col("rho") > F.col("hi") + 1e-12, "HIGH").when(F.col("rho") < F.col("lo") - 1e-12, "LOW").otherwise("MID")
    return d.where("rho is not null").select("bar", "rho", label.alias("regime"))


def regime_lead(signal: DataFrame, event: DataFrame, back: int = 10) -> DataFrame:
    """One row: of the onsets of `event` (bar, flag), how many had `signal` (bar, flag) in the `back` bars up to them, and
    the mean number of bars from its first such bar; agreement is the share of bars with equal flags."""
    d = event.select("bar", F.col("flag").alias("e")).join(signal.select("bar", F.col("flag").alias("s")), "bar").withColumn("one", F.lit(1))
    w = over(["one"])
    fired = F.min(F.when(F.col("s") == 1, F.col("bar"))).over(w.rowsBetween(-(back - 1), 0))
    d = d.withColumns({"onset": (F.col("e") == 1) & (lag("e", ["one"]) == 0), "first": fired})
    on = F.coalesce("onset", F.lit(False))
    return d.agg(
        F.sum(on.cast("int")).alias("onsets"), F.sum((on & F.col("first").isNotNull()).cast("int")).alias("led"),
        F.avg(F.when(on, F.col("bar") - F.col("first"))).alias("mean_lead"), (F.avg((F.col("e") == F.col("s")).cast("double")) * 100).alias("agreement_pct"),
    )


def covariances(panel: DataFrame) -> DataFrame:
    """(asset_a, asset_b, n, cov, corr) of all ordered pairs of assets of a panel, joined by bar, ddof 1."""
    r = panel.withColumn("ret", bar_return("close", KEY)).where("bar > 0").select("asset", "bar", "ret")
    a, b = (r.select(F.col("asset").alias(f"asset_{x}"), "bar", F.col("ret").alias(f"r{x}")) for x in "ab")
    g = a.join(b, "bar").groupBy("asset_a", "asset_b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ra", "rb").alias("cov"), (F.stddev_samp("ra") * F.stddev_samp("rb")).alias("ss"))
    return g.select("asset_a", "asset_b", "n", "cov", F.try_divide("cov", "ss").alias("corr"))


def leaf_order(dist: np.ndarray) -> list[int]:
    """Leaves of the single-linkage tree in pre-order; of two joined clusters the one formed earlier (or the smaller leaf)
    stands left. Equal distances join the smallest pair of leaves first."""
    n = len(dist)
    edges = sorted((dist[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    cluster = {i: (i, [i]) for i in range(n)}  # root leaf -> (id, leaves)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    made = n
    for _, i, j in edges:
        a, b = find(i), find(j)
        if a == b:
            continue
        (ia, la), (ib, lb) = cluster.pop(a), cluster.pop(b)
        root[b] = a
        cluster[a] = (made, la + lb if ia < ib else lb + la)
        made += 1
    return next(iter(cluster.values()))[1]


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity weights: the leaves are halved level by level, and each half takes its share of the weight in
    inverse proportion to the variance of its inverse-variance portfolio.

    With v = 1 / diag(cov), that variance is the sum of v_i v_j cov_ij over the half, over the square of the sum of v. Both
    sums are differences of running sums along the leaf order, so no half's matrix is ever cut out.
    """
    n = len(cov)
    if n == 1:
        return np.ones(1)
    own = np.diag(cov)
    corr = cov / np.sqrt(own[:, None] * own)
    distance = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    np.fill_diagonal(distance, 0.0)
    order = leaf_order(distance)
    v = 1 / own[order]
    area, length = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
    area[1:, 1:] = (cov[np.ix_(order, order)] * v[:, None] * v).cumsum(axis=0).cumsum(axis=1)
    length[1:] = v.cumsum()

    def variance(i: int, j: int) -> float:
        return (area[j, j] - area[i, j] - area[j, i] + area[i, i]) / (length[j] - length[i]) ** 2

    weight, spans = np.ones(n), [(0, n)]
    for i, j in spans:  # grows while it is walked
        if j - i > 1:
            m = (i + j) // 2
            near, far = variance(i, m), variance(m, j)
            weight[i:m] *= far / (near + far)
            weight[m:j] *= near / (near + far)
            spans += [(i, m), (m, j)]
    out = np.empty(n)
    out[order] = weight
    return out


def hrp_weights(panel: DataFrame) -> DataFrame:
    """(asset, weight). Covariances are a distributed aggregation; only the matrix of m assets squared meets in one task."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="asset_a", columns="asset_b", values="cov").sort_index().sort_index(axis=1)
        return pd.DataFrame({"asset": m.index, "weight": hrp(m.to_numpy())})

    return covariances(panel).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "asset string, weight double")


__all__ = ["realized_correlation", "correlation_regime", "regime_lead", "covariances", "leaf_order", "hrp", "hrp_weights", "Window"]
