"""The validation battery: permutation test, walk-forward gate, regimes, look-ahead audit, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.windows import Keys, above, bar_return, below, fold_of, lag, roll_mean
from tidemark.operators import scenarios as S
from tidemark.operators.pnl import Costs, strategy_returns
from tidemark.operators.strategies import Strategy
from tidemark.session import cut

OBJECTIVES = {"pf": M.profit_factor, "sharpe": M.sharpe}


def walk_forward(bars: DataFrame, keys: Keys, rule: Strategy, costs: Costs = Costs(), n_folds: int = 6) -> DataFrame:
    """(keys, fold, ret_pct, pf): the rule run afresh inside each fold."""
    k = [*keys, "fold"]
    net = strategy_returns(rule(S.folds(bars, keys, n_folds), k), k, costs)
    return net.groupBy(*k).agg(M.total_return_pct("net").alias("ret_pct"), M.profit_factor("net").alias("pf"))


def gate(folds: DataFrame, keys: Keys, threshold: float = 0.6) -> DataFrame:
    """(keys, folds, profitable, passed): enough of the folds end with a gain."""
    g = folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.sum((F.col("ret_pct") > 0).cast("int")).alias("profitable"))
    return g.withColumn("passed", F.col("profitable") >= threshold * F.col("folds") - 1e-12)


def stream_folds(net: DataFrame, keys: Keys, n_folds: int = 6, active_only: bool = False) -> DataFrame:
    """(keys, fold, ret_pct) of an existing net stream (keys, bar, net); active_only leaves out folds without any nonzero net."""
    d = S.with_length(net, keys).withColumn("fold", fold_of(F.col("n"), n_folds))
    out = d.groupBy(*keys, "fold").agg(M.total_return_pct("net").alias("ret_pct"), F.max((F.coalesce(F.col("net"), F.lit(0.0)) != 0).cast("int")).alias("active"))
    return (out.where("active = 1") if active_only else out).drop("active")


def stream_gate(net: DataFrame, keys: Keys, n_folds: int = 6, active_only: bool = False, threshold: float | None = None) -> DataFrame:
    """(keys, profitable, folds, verdict) of an existing net stream: PASS if enough of its folds end with a gain, else FAIL. The
    threshold is 0.6, or 0.5 with active_only, which counts only folds with a nonzero net: N/A with 0 folds if there are none."""
    least = threshold if threshold is not None else 0.5 if active_only else 0.6
    folds = stream_folds(net, keys, n_folds, active_only).groupBy(*keys).agg(F.sum((F.col("ret_pct") > 0).cast("int")).alias("profitable"), F.count(F.lit(1)).alias("folds"))
    d = net.select(*keys).distinct().join(folds, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("profitable", "folds")})
    enough = F.col("profitable") >= least * F.col("folds") - 1e-12
    return d.withColumn("verdict", F.when(F.col("folds") == 0, "N/A").when(enough, "PASS").otherwise("FAIL"))


def recent_consistency(net: DataFrame, keys: Keys, n_folds: int = 6, recent: int = 3) -> DataFrame:
    """(keys, recent_profitable, recent_ret_pct) over the last `recent` folds."""
    d = S.with_length(net, keys).withColumn("fold", fold_of(F.col("n"), n_folds)).where(F.col("fold") >= n_folds - recent)
    per = d.groupBy(*keys, "fold").agg(M.total_return_pct("net").alias("r"), F.sum(F.log1p(F.greatest(F.col("net"), F.lit(-0.999999)))).alias("logs"))
    return per.groupBy(*keys).agg(F.sum((F.col("r") > 0).cast("int")).alias("recent_profitable"), (F.expm1(F.sum("logs")) * 100).alias("recent_ret_pct"))


def trend_regime(keys: Keys, n: int = 50) -> Column:
    """UP, DOWN or FLAT by the close against its mean and the mean's slope; needs a column __ma = roll_mean(close, n)."""
    slope = F.col("__ma") - lag("__ma", keys)
    zero = F.lit(0.0)
    return F.when(above(F.col("close"), F.col("__ma")) & above(slope, zero), "UP").when(below(F.col("close"), F.col("__ma")) & below(slope, zero), "DOWN").otherwise("FLAT")


def regime_check(bars: DataFrame, keys: Keys, rule: Strategy, costs: Costs = Costs(), ma: int = 50) -> DataFrame:
    """(keys, regime, n, mean_bps, pf, beta): three rows a key; beta marks rules that earn in UP and not in DOWN."""
    d = strategy_returns(rule(bars, keys), keys, costs).withColumn("__ma", roll_mean("close", ma, keys)).withColumn("regime", trend_regime(keys, ma))
    seen = d.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"), M.mean_bps("net").alias("mean_bps"), M.profit_factor("net").alias("pf"))
    all_rows = bars.select(*keys).distinct().withColumn("regime", F.explode(F.array(F.lit("UP"), F.lit("DOWN"), F.lit("FLAT"))))
    out = all_rows.join(seen, [*keys, "regime"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "mean_bps": F.coalesce("mean_bps", F.lit(0.0)), "pf": F.coalesce("pf", F.lit(1.0))})
    beta = out.groupBy(*keys).agg((F.max(F.when(F.col("regime") == "UP", F.col("mean_bps"))) > 0).alias("u"), (F.max(F.when(F.col("regime") == "DOWN", F.col("mean_bps"))) <= 0).alias("d"))
    return out.join(beta.select(*keys, (F.col("u") & F.col("d")).alias("beta")), list(keys))


def market_sign(net: DataFrame, market: DataFrame, keys: Keys) -> DataFrame:
    """(keys, up_bps, down_bps, neutral, directional) of net on bars where the market (bar, market_ret) rose and fell."""
    d = net.join(market.select("bar", "market_ret"), "bar", "left")
    out = d.groupBy(*keys).agg(M.mean_bps(F.when(F.col("market_ret") > 0, F.col("net"))).alias("up_bps"), M.mean_bps(F.when(F.col("market_ret") < 0, F.col("net"))).alias("down_bps"))
    return out.withColumns({"neutral": (F.col("up_bps") > 0) & (F.col("down_bps") > 0), "directional": F.col("up_bps") * F.col("down_bps") < 0})


def lookahead_audit(bars: DataFrame, keys: Keys, rule: Strategy, n_cuts: int = 12, warmup: int = 50) -> DataFrame:
    """(keys, cuts, mismatches, clean): the decision at the last bar of each truncated history against that of the full one."""
    k = [*keys, "cut"]
    full = rule(bars, keys).select(*keys, F.col("bar").alias("__at"), F.col("position").alias("__full"))
    part = rule(S.truncations(bars, keys, n_cuts, warmup), k).where(F.col("bar") == F.col("cut") - 1).select(*keys, "cut", F.col("bar").alias("__at"), "position")
    close = F.abs(F.col("position") - F.col("__full")) <= 1e-8 + 1e-5 * F.abs(F.col("__full"))
    same = F.when(F.col("position").isNull() | F.col("__full").isNull(), F.col("position").eqNullSafe(F.col("__full"))).otherwise(close)
    out = part.join(full, [*keys, "__at"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("cuts"), F.sum((~same).cast("int")).alias("mismatches"))
    return out.withColumn("clean", F.col("mismatches") == 0)


def mcpt(bars: DataFrame, keys: Keys, rule: Strategy, costs: Costs = Costs(), n_perm: int = 1000, objective: str = "pf", start: int = 0, seed: int = 42) -> DataFrame:
    """(keys, real, perm_mean, perm_p95, n_perm, p_value, verdict): the rule's score on real bars against its scores on
    permuted ones. Permutations are a key: bars * n_perm narrow rows, two shuffles by (keys, perm_id)."""
    score = OBJECTIVES[objective]
    k = [*keys, "perm_id"]
    real = strategy_returns(rule(bars, keys), keys, costs).groupBy(*keys).agg(score("net").alias("real"))
    perm = strategy_returns(rule(S.permute_prices(bars, keys, n_perm, start, seed), k), k, costs).groupBy(*k).agg(score("net").alias("score"))
    finite = F.when(F.abs("score") < float("inf"), F.col("score"))
    out = perm.join(real, list(keys)).groupBy(*keys).agg(
        F.first("real").alias("real"), F.avg(finite).alias("perm_mean"), F.percentile("score", F.lit(0.95)).alias("perm_p95"), F.count(F.lit(1)).alias("n_perm"), M.p_value("real", "score").alias("p_value")
    )
    return out.withColumn("verdict", verdict(F.col("p_value")))


def verdict(p: Column) -> Column:
    return F.when(p < 0.01, "REAL").when(p < 0.05, "SUSPECT").otherwise("NOISE")


def sign_flip(net: DataFrame, keys: Keys, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, pf, n_perm, p_value): profit factor of a stream (keys, bar, net) against streams with random signs."""
    reps = S.replicates(net.select(*keys, "bar", "net", S.salt(f"sign{seed}", keys).alias("__salt")), n_perm)
    bit = S.draw(F.col("__salt"), F.col("perm_id"), F.col("bar")) < 2**31
    perm = reps.withColumn("net", F.when(bit, F.col("net")).otherwise(-F.col("net"))).groupBy(*keys, "perm_id").agg(M.profit_factor("net").alias("score"))
    real = net.groupBy(*keys).agg(M.profit_factor("net").alias("pf"))
    return perm.join(real, list(keys)).groupBy(*keys).agg(F.first("pf").alias("pf"), F.count(F.lit(1)).alias("n_perm"), M.p_value("pf", "score").alias("p_value"))


def regime_autocorr(returns: DataFrame, keys: Keys, n_perm: int = 2000, seed: int = 0, least: int = 30) -> DataFrame:
    """(keys, n, autocorr, p_value): correlation of today's with tomorrow's return over rows (keys, bar, today, tomorrow),
    two-sided against shuffles of tomorrow; null with less than `least` rows."""
    real = returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), M.safe_corr("today", "tomorrow").alias("autocorr"))
    shuffled = S.shuffle_values(returns, keys, "tomorrow", n_perm, seed, ("today",))
    perm = shuffled.groupBy(*keys, "perm_id").agg(M.safe_corr("today", "tomorrow").alias("score"))
    p = perm.join(real, list(keys)).groupBy(*keys).agg(M.p_value(F.abs("autocorr"), F.abs("score")).alias("p_value"))
    out = real.join(p, list(keys), "left")
    ok = F.col("n") >= least
    return out.select(*keys, "n", F.when(ok, F.col("autocorr")).alias("autocorr"), F.when(ok, F.col("p_value")).alias("p_value"))


def replay(bars: DataFrame, registry: dict[str, Strategy], keys: Keys, costs: Costs = Costs(), n_perm: int = 1000, n_folds: int = 6, n_cuts: int = 12, warmup: int = 50, ma: int = 50) -> tuple[DataFrame, DataFrame]:
    """(scores, positions) of every rule of the registry over one frame of scenarios.

    The real bars, their folds and truncated histories are rows of one frame under the key (keys, scenario, number), written
    once; the permutations, nearly all of the rows, stay partitioned by (keys, number), and are written if more than one rule
    reads them. scores: one row per (strategy, keys, scenario, number) with pf, ret_pct, at and position (its last bar and the
    decision there), up_bps and down_bps (by the trend of the real bars). positions: (strategy, keys, at, full), the
    decisions on the real bars.
    """
    k = [*keys, "scenario", "number"]
    real = bars.withColumn("__ma", roll_mean("close", ma, keys)).withColumn("regime", trend_regime(keys, ma)).drop("__ma")
    shape = [*keys, "bar", *(c for c in ("day",) if c in bars.columns), "open", "high", "low", "close"]
    none = F.lit(None).cast("string")

    def scene(df: DataFrame, name: str, number: Column, regime: Column) -> DataFrame:
        return df.select(*shape, F.lit(name).alias("scenario"), number.cast("int").alias("number"), regime.alias("regime"))

    checks = scene(real, "real", F.lit(0), F.col("regime")).unionByName(scene(S.folds(bars, keys, n_folds), "fold", F.col("fold"), none))
    checks = cut(checks.unionByName(scene(S.truncations(bars, keys, n_cuts, warmup), "cut", F.col("cut"), none)))
    perms = S.permute_prices(bars, keys, n_perm)
    perms = perms.join(bars.select(*keys, "bar", "day"), [*keys, "bar"]) if "day" in bars.columns else perms
    perms = cut(perms) if len(registry) > 1 else perms

    def run(frame: DataFrame, by: list[str]) -> DataFrame:
        out = None
        for name, rule in registry.items():
            one = strategy_returns(rule(frame, by), by, costs).withColumn("strategy", F.lit(name)).select("strategy", *by, "bar", "position", "net", *(["regime"] if "scenario" in by else []))
            out = one if out is None else out.unionByName(one)
        return out

    seen = run(checks, k)
    of = lambda regime: M.mean_bps(F.when(F.col("regime") == regime, F.col("net")))
    scores = seen.groupBy("strategy", *k).agg(
        M.profit_factor("net").alias("pf"), M.total_return_pct("net").alias("ret_pct"), F.max("bar").alias("at"), F.max_by("position", "bar").alias("position"), of("UP").alias("up_bps"), of("DOWN").alias("down_bps")
    )
    drawn = run(perms, [*keys, "perm_id"]).groupBy("strategy", *keys, "perm_id").agg(M.profit_factor("net").alias("pf"))
    scores = scores.unionByName(drawn.withColumnRenamed("perm_id", "number").withColumn("scenario", F.lit("perm")), allowMissingColumns=True)
    return scores, seen.where("scenario = 'real'").select("strategy", *keys, F.col("bar").alias("at"), F.col("position").alias("full"))


def verdicts(bars: DataFrame, registry: dict[str, Strategy], keys: Keys, costs: Costs = Costs(), n_perm: int = 1000, threshold: float = 0.6) -> DataFrame:
    """(strategy, keys, real, p_value, folds, profitable, passed, cuts, mismatches, clean, beta): all checks of each rule and key
    by one replay; the rules are those of mcpt, gate, lookahead_audit and regime_check."""
    cell = ["strategy", *keys]
    scores, full = replay(bars, registry, keys, costs, n_perm)
    scores = cut(scores)  # one row a scenario
    real = scores.where("scenario = 'real'").select(*cell, F.col("pf").alias("real"), ((F.col("up_bps") > 0) & (F.col("down_bps") <= 0)).alias("beta"))
    perm = scores.where("scenario = 'perm'").join(real, cell).groupBy(*cell).agg(F.first("real").alias("real"), F.first("beta").alias("beta"), M.p_value("real", "pf").alias("p_value"))
    folds = gate(scores.where("scenario = 'fold'"), cell, threshold)
    close = F.abs(F.col("position") - F.col("full")) <= 1e-8 + 1e-5 * F.abs(F.col("full"))
    same = F.when(F.col("position").isNull() | F.col("full").isNull(), F.col("position").eqNullSafe(F.col("full"))).otherwise(close)
    audit = scores.where("scenario = 'cut'").join(full, [*cell, "at"]).groupBy(*cell).agg(F.count(F.lit(1)).alias("cuts"), F.sum((~same).cast("int")).alias("mismatches"))
    out = perm.join(folds, cell, "left").join(audit, cell, "left").withColumn("clean", F.col("mismatches") == 0)
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("passed", "clean")})


def full_gauntlet(bars: DataFrame, keys: Keys, rule: Strategy, costs: Costs = Costs(), n_perm: int = 1000) -> DataFrame:
    """One row a key with every check and survives: a clean audit, p under 0.01 and the gate passed."""
    out = verdicts(bars, {"rule": rule}, keys, costs, n_perm).withColumn("verdict", verdict(F.col("p_value")))
    survives = F.col("clean") & (F.col("p_value") < 0.01) & F.col("passed")
    return out.select(*keys, "clean", "mismatches", "real", "p_value", "verdict", "folds", "profitable", "passed", "beta", survives.alias("survives"))


def market_of(bars: DataFrame) -> DataFrame:
    """(bar, market_ret): the equal-weight mean return of all assets."""
    r = bars.withColumn("__r", bar_return("close", ["asset"]))
    return r.groupBy("bar").agg(F.avg("__r").alias("market_ret"))


def grid_verdicts(bars: DataFrame, registry: dict[str, Strategy], keys: Keys, costs: Costs = Costs(), n_perm: int = 200, alpha: float = 0.05) -> DataFrame:
    """(strategy, keys, pf, p_value, beta, passed, clean, raw_sig, corrected_sig) over strategies x assets. raw_sig takes p under
    alpha, the walk-forward gate passed and a clean look-ahead audit; corrected_sig p under alpha over all cells, both of these
    and no beta. Every rule runs on the same permutations."""
    out = verdicts(bars, registry, keys, costs, n_perm).withColumn("one", F.lit(1))
    n = bars.select(*keys).distinct().agg((F.count(F.lit(1)) * len(registry)).alias("cells")).withColumn("one", F.lit(1))
    out = out.join(F.broadcast(n), "one")  # one row
    holds = F.col("passed") & F.col("clean")
    raw, corrected = (F.col("p_value") < alpha) & holds, (F.col("p_value") < alpha / F.col("cells")) & holds & ~F.col("beta")
    return out.select("strategy", *keys, F.col("real").alias("pf"), "p_value", "beta", "passed", "clean", raw.alias("raw_sig"), corrected.alias("corrected_sig"))


def panic_battery(labels: DataFrame, keys: Keys, crisis: int, ret: str = "ret", costs: Costs = Costs(), n_perm: int = 2000, least: int = 30) -> DataFrame:
    """(keys, n, autocorr, p_value, ret_pct, pf, active, survives) of labels (keys, bar, ret, regime): does the return after
    a crisis bar lean against it, does fading it pay, and does it survive a Bonferroni bar over all keys."""
    from tidemark.operators.pnl import prelagged_returns
    from tidemark.operators.regimes import crisis_fade

    d = labels.withColumn("tomorrow", lag(ret, keys, -1)).where((F.col("regime") == crisis) & F.col("tomorrow").isNotNull())
    ac = regime_autocorr(d.select(*keys, "bar", F.col(ret).alias("today"), "tomorrow"), keys, n_perm, least=least)
    fade = prelagged_returns(crisis_fade(labels, keys, crisis, ret), keys, ret, costs)
    fade = fade.groupBy(*keys).agg(M.total_return_pct("net").alias("ret_pct"), M.profit_factor("net").alias("pf"), F.sum((F.col("position") != 0).cast("int")).alias("active"))
    out = ac.join(fade, list(keys)).withColumn("one", F.lit(1))
    n = fade.groupBy().agg(F.count(F.lit(1)).alias("all")).withColumn("one", F.lit(1))
    out = out.join(F.broadcast(n), "one")  # one row
    return out.select(*keys, "n", "autocorr", "p_value", "ret_pct", "pf", "active", F.coalesce((F.col("autocorr") < 0) & (F.col("p_value") < 0.05 / F.col("all")), F.lit(False)).alias("survives"))
