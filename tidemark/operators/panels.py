"""Panels of assets: cross-sectional portfolios, pairs, dual momentum, inverse volatility, factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.windows import bar_return, change, fold_of, hold, lag, over, roll_std
from tidemark.operators import battery
from tidemark.operators.pnl import Costs, pair_returns, portfolio_returns
from tidemark.operators.scenarios import shuffle_values, with_length
from tidemark.operators.strategies import spread_reversion

KEY = ["asset"]


def build_panel(prices: DataFrame, order: str, least: int = 10) -> DataFrame:
    """(asset, bar, close): from the first date with `least` assets on, only assets with a price on every date since."""
    per_date = prices.where("close is not null").groupBy(order).agg(F.count_distinct("asset").alias("n"))
    start = per_date.where(F.col("n") >= least).agg(F.min(order).alias("start"))
    dates = per_date.join(F.broadcast(start), F.col(order) >= F.col("start")).select(order)  # start is one row
    numbered = dates.withColumn("bar", F.row_number().over(Window.orderBy(order)) - 1)  # one row per date of the calendar
    d = prices.where("close is not null").join(F.broadcast(numbered), order)
    total = numbered.agg(F.count(F.lit(1)).alias("dates"))
    full = d.groupBy("asset").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(total), F.col("c") == F.col("dates")).select("asset")
    return d.join(full, "asset", "left_semi").select("asset", "bar", "close")


def xs_signal(panel: DataFrame, kind: str, lookback: int, skip: int = 0) -> DataFrame:
    """panel with score: momentum up to `skip` bars ago, reversal (negated return) or low volatility (negated deviation)."""
    if kind == "momentum":
        score = F.try_divide(lag("close", KEY, skip) if skip else F.col("close"), lag("close", KEY, lookback + skip)) - 1
    elif kind == "reversal":
        score = -change("close", KEY, lookback)
    else:
        panel = panel.withColumn("__r", change("close", KEY))
        score = -roll_std("__r", lookback, KEY)
    return panel.withColumn("score", score).drop("__r")


def rank_weights(df: DataFrame, k: int, due: Column, scenario: tuple[str, ...] = ()) -> DataFrame:
    """df (scenario, asset, bar, score) with weight: on due bars with at least 2k scores +1/k for the best k and -1/k for
    the worst k, held until the next such bar. Only finite scores are ranked; ties go by asset."""
    date = Window.partitionBy(*scenario, "bar")
    s = M.finite("score")
    d = df.withColumn("__s", s)
    best = F.row_number().over(date.orderBy(F.desc_nulls_last("__s"), F.desc("asset")))
    worst = F.row_number().over(date.orderBy(F.asc_nulls_last("__s"), F.asc("asset")))
    d = d.withColumns({"__n": F.count("__s").over(date), "__b": best, "__w": worst})
    w = F.when(F.col("__s").isNull(), 0.0).when(F.col("__b") <= k, 1.0 / k).when(F.col("__w") <= k, -1.0 / k).otherwise(0.0)
    return d.withColumn("weight", F.coalesce(hold(F.when(due & (F.col("__n") >= 2 * k), w), [*scenario, "asset"]), F.lit(0.0))).drop("__s", "__n", "__b", "__w")


def every(n: int) -> Column:
    return (F.pmod("bar", F.lit(n)) == 0) & (F.col("bar") > 0)


def xs_portfolio(panel: DataFrame, kind: str, lookback: int, k: int, skip: int = 0, rebal: int = 21, costs: Costs = Costs(), scenario: tuple[str, ...] = ()) -> DataFrame:
    """(bar, net) of the long-short portfolio."""
    d = rank_weights(xs_signal(panel, kind, lookback, skip), k, every(rebal)).withColumn("ret", bar_return("close", KEY))
    return portfolio_returns(d, KEY, (), costs)


def xs_permuted(panel: DataFrame, kind: str, lookback: int, k: int, n_perm: int, skip: int = 0, rebal: int = 21, costs: Costs = Costs(), seed: int = 42) -> DataFrame:
    """(real, n_perm, p_value): the portfolio's profit factor against panels whose assets' returns are each shuffled."""
    r = panel.withColumn("ret", bar_return("close", KEY))
    perm = shuffle_values(r, KEY, "ret", n_perm, seed)
    pk = ["asset", "perm_id"]
    path = F.exp(F.sum(F.log1p("ret")).over(over(pk).rowsBetween(Window.unboundedPreceding, 0))) * 100
    perm = perm.withColumn("close", path).withColumn("ret", bar_return("close", pk))
    if kind == "momentum":
        score = F.try_divide(lag("close", pk, skip) if skip else F.col("close"), lag("close", pk, lookback + skip)) - 1
    elif kind == "reversal":
        score = -change("close", pk, lookback)
    else:
        score = -roll_std("ret", lookback, pk)
    d = rank_weights(perm.withColumn("score", score), k, every(rebal), ("perm_id",))
    scores = portfolio_returns(d, pk, ("perm_id",), costs).groupBy("perm_id").agg(M.profit_factor("net").alias("score"), F.lit(1).alias("one"))
    real = xs_portfolio(panel, kind, lookback, k, skip, rebal, costs).agg(M.profit_factor("net").alias("real"), F.lit(1).alias("one"))
    return scores.join(real, "one").agg(F.first("real").alias("real"), F.count(F.lit(1)).alias("n_perm"), M.p_value("real", "score").alias("p_value"))


def pair_frames(panel: DataFrame, assets: list[str] | None = None) -> DataFrame:
    """(asset_a, asset_b, bar, spread, ret_a, ret_b) of all pairs of assets on their common bars.

    m assets have m (m - 1) / 2 pairs, of all assets of the panel or of the named ones. The join is by bar.
    """
    chosen = panel if assets is None else panel.where(F.col("asset").isin(list(assets)))
    p = chosen.withColumn("ret", bar_return("close", KEY)).select("asset", "bar", "close", "ret")
    a, b = (p.select(F.col("asset").alias(f"asset_{x}"), "bar", F.col("close").alias(f"close_{x}"), F.col("ret").alias(f"ret_{x}")) for x in "ab")
    d = a.join(b, "bar").where("asset_a < asset_b and close_a > 0 and close_b > 0")
    k = ["asset_a", "asset_b"]
    ratio = F.ln("close_a") - F.ln("close_b")
    return d.withColumn("spread", ratio - F.avg(ratio).over(Window.partitionBy(*k))).select(*k, "bar", "spread", "ret_a", "ret_b")


def pairs_scan(panel: DataFrame, costs: Costs = Costs(), n_folds: int = 6, recent: int = 3, assets: list[str] | None = None) -> DataFrame:
    """(asset_a, asset_b, ret_pct, pf, recent_profitable) of the spread rule over all pairs, in one plan."""
    k = ["asset_a", "asset_b"]
    net = pair_returns(spread_reversion(pair_frames(panel, assets), k), k, costs)
    total = net.groupBy(*k).agg(M.total_return_pct("net").alias("ret_pct"), M.profit_factor("net").alias("pf"))
    folds = with_length(net, k).withColumn("fold", fold_of(F.col("n"), n_folds)).where(F.col("fold") >= n_folds - recent).groupBy(*k, "fold").agg(M.total_return_pct("net").alias("r"))
    return total.join(folds.groupBy(*k).agg(F.sum((F.col("r") > 0).cast("int")).alias("recent_profitable")), k)


def spread_prices(frames: DataFrame) -> DataFrame:
    """(asset_a, asset_b, bar, open, high, low, close): the log spread of pair_frames as a price around 100, its bars numbered anew,
    so that every rule and test for prices runs on a pair."""
    k = ["asset_a", "asset_b"]
    d = frames.select(*k, (F.row_number().over(over(k)) - 1).alias("bar"), (100 * F.exp("spread")).alias("close"))
    return d.select(*k, "bar", *(F.col("close").alias(c) for c in ("open", "high", "low", "close")))


def spread_rule(prices: DataFrame, keys: list[str]) -> DataFrame:
    """spread_reversion on spread prices."""
    return spread_reversion(prices.withColumn("spread", F.ln("close")), keys)


def pairs_verdicts(panel: DataFrame, costs: Costs = Costs(), n_perm: int = 300, n_folds: int = 6, recent: int = 3, least: int = 50, alpha: float = 0.05, seed: int = 42, assets: list[str] | None = None) -> DataFrame:
    """(asset_a, asset_b, active, ret_pct, recent_profitable, recent_ret_pct, p_value, corrected_bar, candidate) of the pairs
    with at least `least` bars in a position. p_value is the permutation test of the rule on the spread as a price; the bar is
    alpha over the pairs tested; a candidate is under it and gained in each of the last folds."""
    k = ["asset_a", "asset_b"]
    frames = pair_frames(panel, assets)
    net = pair_returns(spread_reversion(frames, k), k, costs)
    total = net.groupBy(*k).agg(M.total_return_pct("net").alias("ret_pct"), F.sum((F.col("position") != 0).cast("int")).alias("active")).where(F.col("active") >= least)
    prices = spread_prices(frames.join(total.select(*k), k, "left_semi"))
    test = battery.mcpt(prices, k, spread_rule, costs, n_perm, seed=seed)
    out = total.join(battery.recent_consistency(net.select(*k, "bar", "net"), k, n_folds, recent), k).join(test.select(*k, "p_value"), k).withColumn("one", F.lit(1))
    n = total.groupBy().agg(F.count(F.lit(1)).alias("tested")).withColumn("one", F.lit(1))
    out = out.join(F.broadcast(n), "one").withColumn("corrected_bar", alpha / F.col("tested"))  # one row
    live = (F.col("recent_profitable") == recent) & (F.col("recent_ret_pct") > 0)
    return out.select(*k, "active", "ret_pct", "recent_profitable", "recent_ret_pct", "p_value", "corrected_bar", (live & (F.col("p_value") < F.col("corrected_bar"))).alias("candidate"))


def dual_momentum(panel: DataFrame, risk: str, safe: str, lookback: int = 252, rebal: int = 21, costs: Costs = Costs()) -> DataFrame:
    """(bar, held, net): every rebal bars the risk asset if its trailing return is positive and at least the safe one's,
    else the safe asset; a switch costs one turn."""
    p = panel.where(F.col("asset").isin(risk, safe)).withColumns({"ret": bar_return("close", KEY), "past": change("close", KEY, lookback)})
    a, b = (p.where(F.col("asset") == x).select("bar", F.col("ret").alias(f"ret_{n}"), F.col("past").alias(f"past_{n}")) for x, n in ((risk, "a"), (safe, "b")))
    d = a.join(b, "bar").withColumn("one", F.lit(1))
    known = F.col("past_a").isNotNull() & F.col("past_b").isNotNull()
    pick = F.when(known & (F.col("past_a") > 0) & (F.col("past_a") >= F.col("past_b")), risk).when(known, safe)
    due = (F.pmod("bar", F.lit(rebal)) == 0) & (F.col("bar") >= lookback)
    d = d.withColumn("held", hold(F.when(due, pick), ["one"]))
    prev = lag("held", ["one"])
    gross = F.when(prev == risk, F.col("ret_a")).when(prev == safe, F.col("ret_b")).otherwise(0.0)
    switched = prev.isNotNull() & (F.col("held") != prev)
    return d.select("bar", "held", (gross - F.when(switched, costs.per_turn).otherwise(0.0)).alias("net"))


def inverse_vol(panel: DataFrame, lookback: int = 63, rebal: int = 21) -> DataFrame:
    """(asset, bar, ret, weight): weights 1/deviation, summing to 1, renewed every rebal bars if all assets have one."""
    d = panel.withColumn("__r", change("close", KEY)).withColumns({"__sd": roll_std("__r", lookback, KEY), "ret": bar_return("close", KEY)})
    date = Window.partitionBy("bar")
    inv = F.when(F.col("__sd") > 0, 1 / F.col("__sd"))
    d = d.withColumn("__i", inv).withColumns({"__all": F.count("__i").over(date) == F.count(F.lit(1)).over(date), "__sum": F.sum("__i").over(date)})
    due = every(rebal) & F.col("__all")
    return d.withColumn("weight", F.coalesce(hold(F.when(due, F.try_divide("__i", "__sum")), KEY), F.lit(0.0))).select("asset", "bar", "ret", "weight")


def zscore(value: str, date: list[str]) -> Column:
    w = Window.partitionBy(*date)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-12)


def factor_score(snapshot: DataFrame, date: list[str]) -> DataFrame:
    """snapshot (date, ticker, pe, pb, roe, gross_margin) with value, quality and combo scores: sums of z-scores over the
    tickers of a date, a missing part as 0 unless all are missing; value takes -pe and -pb where positive."""
    d = snapshot.withColumns({"__pe": F.when(F.col("pe") > 0, -F.col("pe")), "__pb": F.when(F.col("pb") > 0, -F.col("pb"))})
    z = {c: zscore(c, date) for c in ("__pe", "__pb", "roe", "gross_margin")}
    d = d.withColumns({f"__z{c}": x for c, x in z.items()})

    def total(*cols: str) -> Column:
        some = F.coalesce(*(F.col(f"__z{c}") for c in cols)).isNotNull()
        return F.when(some, sum((F.coalesce(F.col(f"__z{c}"), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(f"__z{cols[0]}"), F.lit(0.0))))

    out = d.withColumns({"value": total("__pb", "__pe"), "quality": total("roe", "gross_margin"), "combo": total("__pb", "__pe", "roe", "gross_margin")})
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def month_ends(panel: DataFrame, date: str) -> DataFrame:
    """(bar, month): the last bar of each calendar month; the last trading day, whatever the calendar's is."""
    return panel.groupBy(F.trunc(date, "MM").alias("month")).agg(F.max("bar").alias("bar"))


def factor_backtest(panel: DataFrame, scores: DataFrame, share: float = 0.2, least: int = 6, costs: Costs = Costs()) -> DataFrame:
    """(asset, bar, ret, weight) of panel (asset, bar, close) rebalanced on the bars of scores (asset, bar, score): the best
    and the worst share of the scored assets, at least 2 each, held until the next bar with `least` scores."""
    date = Window.partitionBy("bar")
    s = scores.where(M.finite("score").isNotNull()).withColumn("__n", F.count("score").over(date))
    s = s.withColumns({"__k": F.greatest(F.lit(2), F.floor(share * F.col("__n")).cast("int")), "__b": F.row_number().over(date.orderBy(F.desc("score"), F.desc("asset"))), "__w": F.row_number().over(date.orderBy(F.asc("score"), F.asc("asset")))})
    w = F.when(F.col("__b") <= F.col("__k"), 1.0 / F.col("__k")).when(F.col("__w") <= F.col("__k"), -1.0 / F.col("__k")).otherwise(0.0)
    s = s.where(F.col("__n") >= least).select("asset", "bar", w.alias("__weight"))
    due = s.select("bar").distinct().withColumn("__due", F.lit(True))
    d = panel.withColumn("ret", bar_return("close", KEY)).join(s, ["asset", "bar"], "left").join(due, "bar", "left")
    new = F.when(F.col("__due"), F.coalesce("__weight", F.lit(0.0)))  # an asset without a score leaves at a rebalance
    return d.withColumn("weight", F.coalesce(hold(new, KEY), F.lit(0.0))).select("asset", "bar", "ret", "weight")


def fixed_weight_permutation(weights: DataFrame, n_perm: int, costs: Costs = Costs(), seed: int = 42) -> DataFrame:
    """(real, n_perm, p_value) of weights (asset, bar, ret, weight): each asset's returns shuffled, weights and turnover held."""
    held = weights.withColumn("held", F.coalesce(lag("weight", KEY), F.lit(0.0))).withColumn("cost", F.abs(F.col("weight") - F.col("held")) * costs.per_turn)
    real = portfolio_returns(weights, KEY, (), costs).agg(M.profit_factor("net").alias("real"), F.lit(1).alias("one"))
    perm = shuffle_values(held.where("ret is not null"), KEY, "ret", n_perm, seed, ("held", "cost"))
    net = perm.groupBy("perm_id", "bar").agg(F.sum(F.col("held") * F.col("ret") - F.col("cost")).alias("net"))
    scores = net.groupBy("perm_id").agg(M.profit_factor("net").alias("score"), F.lit(1).alias("one"))
    return scores.join(real, "one").agg(F.first("real").alias("real"), F.count(F.lit(1)).alias("n_perm"), M.p_value("real", "score").alias("p_value"))
