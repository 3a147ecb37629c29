"""Volatility forecasts, their evaluation, and volatility targeting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.windows import Keys, decay_sum, hold, over

LAM = 0.94


def ewma_variance(df: DataFrame, keys: Keys, ret: str, train: int, lam: float = LAM, seed: int = 20, out: str = "ewma") -> DataFrame:
    """df with the variance forecast from the `train` returns before each bar: the recursion v <- lam v + (1 - lam) x^2 over
    them, from the population variance of the first `seed`; null while there are fewer. bar counts 0, 1, 2, ...

    Closed form over running sums: the weights of the train window are those of the whole history less what lies before it.
    """
    df = decay_sum(df.withColumn("__x2", F.col(ret) * F.col(ret)), keys, "__x2", 1 - lam, "__d")
    w = over(keys)
    inside = F.lag("__d", 1).over(w) - F.coalesce(F.lag("__d", train + 1).over(w), F.lit(0.0)) * lam**train
    start = F.var_pop(ret).over(w.rowsBetween(-train, -train + seed - 1))
    ok = F.col("bar") >= train
    return df.withColumn(out, F.when(ok, lam**train * start + (1 - lam) * inside)).drop("__x2", "__d")


def naive_variance(keys: Keys, ret: str, n: int = 21) -> Column:
    """Population variance of the n returns before the bar."""
    return F.var_pop(ret).over(over(keys).rowsBetween(-n, -1))


#: The grid of the GARCH(1,1) parameters.
ALPHAS, BETAS = (0.02, 0.05, 0.08, 0.12, 0.18), (0.70, 0.80, 0.85, 0.90, 0.94)


def garch_variances(pasts: list[np.ndarray]) -> np.ndarray:
    """One-step variance forecasts of GARCH(1,1) models whose parameters maximise the Gaussian likelihood over a grid, with the
    long-run variance at the sample's. The variance at t uses returns before t; the last shock enters once. Samples of less than
    50 finite returns or without variance give their own variance. Samples of equal length and all grid points are one array,
    so the recursion is one loop over time."""
    pasts = [(x := np.asarray(p, float))[np.isfinite(x)] for p in pasts]
    out = np.array([np.var(x) if len(x) else 0.0 for x in pasts], float)
    grid = np.array([(a, b) for a in ALPHAS for b in BETAS if a + b < 0.999])
    alpha, beta = grid[:, 0], grid[:, 1]
    lengths = np.array([len(x) for x in pasts])
    for n in np.unique(lengths[(lengths >= 50) & (out > 0)]):
        rows = np.flatnonzero((lengths == n) & (out > 0))
        squares = np.stack([pasts[i] for i in rows]) ** 2
        omega = out[rows][:, None] * (1 - alpha - beta)
        v, ll = np.repeat(out[rows][:, None], len(grid), axis=1), 0.0
        for t in range(n):
            s = squares[:, t, None]
            ll = ll - np.log(v) - s / v
            v = omega + alpha * s + beta * v
        out[rows] = v[np.arange(len(rows)), np.argmax(ll, axis=1)]
    return out


def garch_variance(x: np.ndarray) -> float:
    return float(garch_variances([x])[0])


def walk_forward_vol(df: DataFrame, keys: Keys, ret: str = "ret", train: int = 504, step: int = 21, target: int = 21, methods: tuple[str, ...] = ("naive", "ewma")) -> DataFrame:
    """(keys, bar, method, forecast, realized): every `step` bars from `train` on, the variance forecast from the train
    returns before and the population variance of the next `target` returns. 'garch' fits one task per (key, bar)."""
    d = ewma_variance(df.select(*keys, "bar", ret), keys, ret, train)
    ahead = over(keys).rowsBetween(0, target - 1)
    d = d.withColumns({"naive": naive_variance(keys, ret, target), "realized": F.when(F.count(ret).over(ahead) == target, F.var_pop(ret).over(ahead))})
    cols = [m for m in methods if m in ("naive", "ewma")]
    d = d.where((F.col("bar") >= train) & (F.pmod(F.col("bar") - train, F.lit(step)) == 0) & F.col("realized").isNotNull())
    if "garch" in methods:

        @F.pandas_udf("double")
        def fit(past: pd.Series) -> pd.Series:
            return pd.Series(garch_variances(past.tolist()))

        k = [*keys, "bar"]
        # each return goes to the due bars that look back on it, at most train / step + 1; only these bars get a list
        first = F.greatest(F.lit(0), F.floor((F.col("bar") - train) / step) + 1)
        due = F.transform(F.sequence(first, F.floor((F.col("bar") - 1) / step) + 1), lambda i: (F.lit(train) + i * step).cast("int"))
        past = df.where(F.col(ret).isNotNull()).select(*keys, F.col("bar").alias("__at"), F.col(ret).alias("__x"), F.explode(F.filter(due, lambda t: (t > F.col("bar")) & (t - train <= F.col("bar")))).alias("bar"))
        past = past.join(d.select(*k), k, "left_semi").groupBy(*k).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__x"))), lambda x: x["__x"]).alias("__past"))
        d, cols = d.join(past, k, "left").withColumn("garch", fit(F.coalesce("__past", F.array().cast("array<double>")))), [*cols, "garch"]
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("forecast")) for m in cols)))
    return d.select(*keys, "bar", one.alias("f"), "realized").select(*keys, "bar", "f.method", "f.forecast", "realized")


def evaluate_vol(forecasts: DataFrame, keys: Keys) -> DataFrame:
    """(keys, method, n, qlike, rmse, vol_corr, gain): gain is the relative fall of qlike against naive."""
    f, v = F.col("forecast"), F.col("realized")
    e = forecasts.groupBy(*keys, "method").agg(
        F.count(F.lit(1)).alias("n"), M.qlike(f, v).alias("qlike"), F.sqrt(F.avg(F.pow(f - v, 2))).alias("rmse"), M.safe_corr(F.sqrt(f), F.sqrt(v)).alias("vol_corr")
    )
    base = F.max(F.when(F.col("method") == "naive", F.col("qlike"))).over(Window.partitionBy(*keys))
    return e.withColumn("gain", F.try_divide(base - F.col("qlike"), base))


def vol_target_weights(df: DataFrame, keys: Keys, ret: str = "ret", target: float = 0.15, lookback: int = 504, most: float = 2.0, rebal: int = 5) -> DataFrame:
    """df with weight = least(target / sqrt(252) / forecast volatility, most), renewed every `rebal` bars and at the first
    bar with a whole lookback, held in between, 0 before."""
    d = ewma_variance(df, keys, ret, lookback, out="__v")
    due = (F.col("bar") >= lookback) & ((F.pmod("bar", F.lit(rebal)) == 0) | (F.col("bar") == lookback))
    w = F.least(F.try_divide(F.lit(target / 252**0.5), F.sqrt("__v")), F.lit(most))
    return d.withColumn("weight", F.coalesce(hold(F.when(due, w), keys), F.lit(0.0))).drop("__v")


def vol_target_report(df: DataFrame, keys: Keys, ret: str = "ret", lookback: int = 504, per_turn: float = 0.0003, **options) -> DataFrame:
    """(keys, overlay, sharpe, vol, max_drawdown, vol_cv) of the targeted stream and of holding, after the lookback."""
    w = over(keys)
    d = vol_target_weights(df, keys, ret, lookback=lookback, **options)
    prev = F.coalesce(F.lag("weight", 1).over(w), F.lit(0.0))
    d = d.withColumn("__t", prev * F.col(ret) - F.abs(F.col("weight") - prev) * per_turn).where(F.col("bar") >= lookback)
    one = F.explode(F.array(F.struct(F.lit("hold").alias("overlay"), F.col(ret).alias("net")), F.struct(F.lit("target").alias("overlay"), F.col("__t").alias("net"))))
    k = [*keys, "overlay"]
    d = d.select(*keys, "bar", one.alias("o")).select(*keys, "bar", "o.overlay", "o.net")
    w = Window.partitionBy(*k).orderBy("bar")
    d = d.withColumn("eq", F.sum(F.log1p(F.greatest("net", F.lit(-0.999999)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({"dd": F.exp(F.col("eq") - F.max("eq").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1, "rv": F.when(F.count("net").over(w.rowsBetween(-62, 0)) == 63, F.stddev_samp("net").over(w.rowsBetween(-62, 0)))})
    return d.groupBy(*k).agg(M.sharpe("net", population=True).alias("sharpe"), M.annual_vol("net").alias("vol"), F.min("dd").alias("max_drawdown"), F.try_divide(F.stddev_samp("rv"), F.avg("rv")).alias("vol_cv"))


def overlay_wins(report: DataFrame, keys: Keys) -> DataFrame:
    """(keys, higher_sharpe, steadier, shallower, survives) of vol_target_report: does the target beat holding in Sharpe ratio, in
    the steadiness of its volatility and in drawdown; it survives with all three."""
    of = lambda c, o: F.max(F.when(F.col("overlay") == o, F.col(c)))
    d = report.groupBy(*keys).agg(
        (of("sharpe", "target") > of("sharpe", "hold")).alias("higher_sharpe"), (of("vol_cv", "target") < of("vol_cv", "hold")).alias("steadier"), (of("max_drawdown", "target") > of("max_drawdown", "hold")).alias("shallower")
    )
    return d.withColumn("survives", F.col("higher_sharpe") & F.col("steadier") & F.col("shallower"))
