"""Gaussian hidden Markov regimes: fitting, filtering, paths and the statistics conditioned on them.

The recursions run per source in numpy inside applyInPandas; models are tiny and travel as columns, so fit and filter are
separate operators and a model is fitted once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.prefix import exact_median
from tidemark.functions.windows import Keys, lag, roll_std

MODEL = "k int, start array<double>, trans array<double>, mean array<double>, var array<double>, loglik double, rounds int"


@dataclass
class Model:
    """Start probabilities, transition matrix, means and variances; states in order of variance, 0 the calmest."""

    start: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    loglik: float = float("nan")
    rounds: int = 0

    def log_density(self, x: np.ndarray) -> np.ndarray:
        v = np.maximum(self.var, 1e-12)
        return -0.5 * (np.log(2 * np.pi * v) + (x[:, None] - self.mean) ** 2 / v)


def forward(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(filtered, scaled densities, scales, log likelihood): probabilities are normalised at every bar, densities by their
    greatest, so nothing underflows."""
    logd = m.log_density(x)
    top = logd.max(axis=1)
    d = np.exp(logd - top[:, None])
    n, k = d.shape
    out, scale = np.empty((n, k)), np.empty(n)
    p = m.start
    for t in range(n):
        p = p * d[t]
        s = p.sum()
        if s <= 0:
            p, s = np.full(k, 1.0 / k), 1e-300
        else:
            p = p / s
        out[t], scale[t] = p, s
        p = p @ m.trans
    return out, d, scale, float(np.log(scale).sum() + top.sum())


def smooth(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(smoothed, expected transitions, log likelihood)."""
    f, d, scale, ll = forward(m, x)
    n, k = f.shape
    b, back = np.ones(k), np.ones((n, k))
    for t in range(n - 2, -1, -1):
        b = m.trans @ (d[t + 1] * b) / scale[t + 1]
        back[t] = b
    g = f * back
    g /= g.sum(axis=1, keepdims=True)
    moves = m.trans * (f[:-1].T @ (d[1:] * back[1:] / scale[1:, None]))
    return g, moves, ll


def fit(x: np.ndarray, k: int = 2, rounds: int = 60, tol: float = 1e-4) -> Model:
    """Baum-Welch from a deterministic start: means at the quantiles 0.1 to 0.9, the sample's variance, sticky transitions."""
    trans = np.full((k, k), 0.1 / max(k - 1, 1)) if k > 1 else np.ones((1, 1))
    if k > 1:
        np.fill_diagonal(trans, 0.9)
    m = Model(np.full(k, 1.0 / k), trans / trans.sum(axis=1, keepdims=True), np.quantile(x, np.linspace(0.1, 0.9, k)), np.full(k, x.var() + 1e-8))
    last = -np.inf
    for i in range(rounds):
        g, moves, ll = smooth(m, x)
        w = g.sum(axis=0) + 1e-300
        mean = g.T @ x / w
        var = (g * (x[:, None] - mean) ** 2).sum(axis=0) / w + 1e-10
        m = Model(g[0], moves / (moves.sum(axis=1, keepdims=True) + 1e-300), mean, var, ll, i + 1)
        if ll - last < tol and i > 5:
            break
        last = ll
    o = np.argsort(m.var, kind="stable")
    return Model(m.start[o], m.trans[np.ix_(o, o)], m.mean[o], m.var[o], m.loglik, m.rounds)


def viterbi_path(m: Model, x: np.ndarray) -> np.ndarray:
    logd, logt = m.log_density(x), np.log(m.trans + 1e-300)
    best, came = np.log(m.start + 1e-300) + logd[0], np.zeros(logd.shape, int)
    for t in range(1, len(x)):
        step = best[:, None] + logt
        came[t] = step.argmax(axis=0)
        best = step.max(axis=0) + logd[t]
    path = np.empty(len(x), int)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def to_row(m: Model) -> dict:
    return {"k": len(m.mean), "start": m.start.tolist(), "trans": m.trans.ravel().tolist(), "mean": m.mean.tolist(), "var": m.var.tolist(), "loglik": m.loglik, "rounds": m.rounds}


def of_row(r) -> Model:
    k = int(r["k"])
    return Model(np.array(r["start"]), np.array(r["trans"]).reshape(k, k), np.array(r["mean"]), np.array(r["var"]))


def key_schema(df: DataFrame, keys: Keys) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def fit_models(df: DataFrame, keys: Keys, ret: str = "ret", k: int = 2, rounds: int = 60, train: float = 1.0) -> DataFrame:
    """One model row per key, from the first `train` share of its bars; keys with less than 2k finite returns have none."""
    keys = list(keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("bar")[ret].to_numpy(float)
        x = x[np.isfinite(x)]
        x = x[: int(len(x) * train)]
        rows = [to_row(fit(x, k, rounds))] if len(x) >= 2 * k else []
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, **r} for r in rows], columns=[*keys, *(c.split()[0] for c in MODEL.split(", "))])

    return df.select(*keys, "bar", ret).groupBy(*keys).applyInPandas(one, f"{key_schema(df, keys)}, {MODEL}")


def label(df: DataFrame, models: DataFrame, keys: Keys, ret: str = "ret", how: str = "filter") -> DataFrame:
    """(keys, bar, ret, regime, belief): regime by the causal filter, the smoother or the Viterbi path; belief is the
    probability of each state (null for the path)."""
    keys = list(keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar").reset_index(drop=True)
        m, x = of_row(pdf.iloc[0]), pdf[ret].fillna(0.0).to_numpy(float)
        if how == "viterbi":
            path, belief = viterbi_path(m, x), [None] * len(x)
        else:
            p = forward(m, x)[0] if how == "filter" else smooth(m, x)[0]
            path, belief = p.argmax(axis=1), p.tolist()
        return pdf[[*keys, "bar", ret]].assign(regime=path, belief=belief)

    d = df.select(*keys, "bar", ret).join(models, keys)  # one model row per key
    bar = df.schema["bar"].dataType.simpleString()
    return d.groupBy(*keys).applyInPandas(one, f"{key_schema(df, keys)}, bar {bar}, `{ret}` double, regime int, belief array<double>")


def describe(models: DataFrame, keys: Keys) -> DataFrame:
    """(keys, regime, ann_return, ann_vol, persistence, duration) in percent and bars."""
    d = models.select(*keys, "k", "mean", "var", "trans", F.posexplode("mean").alias("regime", "__m"))
    stay = F.element_at("trans", F.col("regime") * F.col("k") + F.col("regime") + 1)
    return d.select(*keys, "regime", (F.col("__m") * 25200).alias("ann_return"), (F.sqrt(F.element_at("var", F.col("regime") + 1) * 252) * 100).alias("ann_vol"), stay.alias("persistence"), (1 / (1 - stay + 1e-9)).alias("duration"))


def direction_by_regime(labels: DataFrame, keys: Keys, ret: str = "ret", least: int = 50) -> DataFrame:
    """(keys, regime, n, up_rate, edge): how often the next return is positive in each regime, with at least `least` bars."""
    d = labels.withColumn("__next", lag(ret, keys, -1)).where("__next is not null")
    up = F.avg((F.col("__next") > 0).cast("double"))
    return d.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"), up.alias("up_rate"), F.abs(up - 0.5).alias("edge")).where(F.col("n") >= least)


def crisis_fade(labels: DataFrame, keys: Keys, crisis: int, ret: str = "ret", scale: float = 1.0) -> DataFrame:
    """labels with position: against yesterday's return if yesterday was in the crisis regime."""
    sgn = F.signum(lag(ret, keys))
    return labels.withColumn("position", F.when(lag("regime", keys) == crisis, -sgn * scale).otherwise(0.0))


def overnight_in_calm(df: DataFrame, keys: Keys, crisis: int, ret: str = "ret", n: int = 20, cost: float = 1e-4) -> DataFrame:
    """df (keys, bar, open, close, ret, regime) with calm and net: the return from the close before to the open, less cost, on bars
    out of the crisis regime whose n-bar deviation is at most the key's median of it over the whole sample; else 0."""
    d = df.withColumns({"__sd": roll_std(ret, n, keys), "__night": F.coalesce(F.try_divide(F.col("open"), lag("close", keys)) - 1, F.lit(0.0))})
    d = d.join(exact_median(d, list(keys), "__sd", "__median"), list(keys), "left")
    d = d.withColumn("calm", F.coalesce((F.col("regime") != crisis) & (F.col("__sd") <= F.col("__median")), F.lit(False)))
    return d.withColumn("net", F.when(F.col("calm"), F.col("__night") - cost).otherwise(0.0)).drop("__sd", "__night", "__median")


def conditioned_vol(labels: DataFrame, models: DataFrame, forecasts: DataFrame, keys: Keys, blend: float = 0.5) -> DataFrame:
    """(keys, n, qlike_base, qlike_conditioned, gain_pct): EWMA forecasts blended with the state variances weighted by the
    belief on the bar before. forecasts (keys, bar, method, forecast, realized)."""
    state = F.aggregate(F.zip_with("belief", "var", lambda b, v: b * v), F.lit(0.0), lambda a, x: a + x)
    prior = labels.join(models.select(*keys, "var"), list(keys)).select(*keys, (F.col("bar") + 1).alias("bar"), state.alias("__state"))
    d = forecasts.where("method = 'ewma'").join(prior, [*keys, "bar"])
    e = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), M.qlike("forecast", "realized").alias("qlike_base"), M.qlike((1 - blend) * F.col("forecast") + blend * F.col("__state"), F.col("realized")).alias("qlike_conditioned"))
    return e.withColumn("gain_pct", F.try_divide(F.col("qlike_base") - F.col("qlike_conditioned"), F.col("qlike_base")) * 100)
