"""Queries over bars: windows, strategies, P&L and the validation battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import windows as W
from tidemark.operators import battery, features, ledger, pnl, scenarios, strategies
from tidemark.plans import sql as Q
from tidemark.plans.inputs import BARS, HOURS, bars_once, daily_bars, hourly_bars

KEY = ["asset"]
#: Permutations of the reference: of prices and signs, of the returns inside a regime, of panels and factor weights, of the grid.
PRICE_PERM, REGIME_PERM, PANEL_PERM, GRID_PERM = 1000, 2000, 300, 200
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, d: int = 8) -> Column:
    return F.round(c, d)


def rounded(df: DataFrame, d: int = 8) -> DataFrame:
    return df.select(*(F.round(c, d).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"with {BARS} select asset, bar, round({Q.ret()}, 8) ret from bars")
def bar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).select("asset", "bar", r(W.bar_return("close", KEY)).alias("ret"))


@query(f"""with {BARS} select asset, bar, round({Q.roll('avg', 'close', 20)}, 6) mean20, round({Q.roll('stddev_samp', 'close', 20)}, 4) std20, round({Q.roll('var_samp', 'close', 21)}, 1) var21,
 {Q.roll('max', 'close', 50)} max50, {Q.roll('min', 'close', 50)} min50, round(close - {Q.prev('close')}, 6) diff1 from bars""")
def rolling_stats(spark, sf_dir):
    return daily_bars(spark, sf_dir).select(
        "asset", "bar", r(W.roll_mean("close", 20, KEY), 6).alias("mean20"), r(W.roll_std("close", 20, KEY), 4).alias("std20"), r(W.roll_var("close", 21, KEY), 1).alias("var21"),
        W.roll_max("close", 50, KEY).alias("max50"), W.roll_min("close", 50, KEY).alias("min50"), r(F.col("close") - W.lag("close", KEY), 6).alias("diff1"),
    )


@query(f"with {BARS} select asset, bar, round({Q.ema('close', 12)}, 4) ema12, round({Q.ema('close', 26)}, 4) ema26 from bars")
def ewm_recursive(spark, sf_dir):
    d = W.ewm_mean(W.ewm_mean(daily_bars(spark, sf_dir), KEY, "close", 12, "ema12"), KEY, "close", 26, "ema26")
    return d.select("asset", "bar", r("ema12", 4).alias("ema12"), r("ema26", 4).alias("ema26"))


@query(f"with {BARS} select asset, bar, round({Q.ema('close', 12, True)}, 4) ema12, round({Q.ema('close', 26, True)}, 4) ema26 from bars")
def ewm_adjusted(spark, sf_dir):
    d = W.ewm_mean(W.ewm_mean(daily_bars(spark, sf_dir), KEY, "close", 12, "ema12", True), KEY, "close", 26, "ema26", True)
    return d.select("asset", "bar", r("ema12", 4).alias("ema12"), r("ema26", 4).alias("ema26"))


RSI = f"""d as (select *, close - {Q.prev('close')} dx from bars), u as (select *, {Q.roll('avg', 'case when dx is not null then greatest(dx, 0) end', 14)} up, {Q.roll('avg', 'case when dx is not null then greatest(-dx, 0) end', 14)} dn from d),
rsis as (select *, 100 - 100 / (1 + up / (dn + 1e-12)) rsi from u)"""


@query(f"with {BARS}, {RSI} select asset, bar, round(rsi, 6) rsi from rsis")
def rsi14(spark, sf_dir):
    return strategies.with_rsi(daily_bars(spark, sf_dir), KEY).select("asset", "bar", r("rsi", 6).alias("rsi"))


FEATS = f"""{RSI}, f1 as (select *, close / {Q.prev('close')} - 1 ret_1, close / {Q.prev('close', 5)} - 1 ret_5, close / {Q.prev('close', 20)} - 1 ret_20, close / {Q.prev('close', 50)} - 1 ret_50, (high - low) / close rg, {Q.roll('avg', 'close', 50)} ma, open / {Q.prev('close')} - 1 gap from rsis),
f2 as (select *, {Q.roll('stddev_samp', 'ret_1', 20)} vol, {Q.roll('avg', 'rg', 20)} rgl from f1), f3 as (select *, {Q.roll('avg', 'vol', 252)} vl from f2),
feats as (select asset, bar, close, ret_1, ret_5, ret_20, vol / nullif(vl, 0) vol_norm, ret_50 / (vol * sqrt(50) + 1e-12) mom_norm, rsi / 100 rsi, rg / (rgl + 1e-12) range_norm, (close - ma) / close dist_ma, gap / (vol + 1e-12) gap_norm from f3)"""


@query(f"with {BARS}, {FEATS} select asset, bar, {', '.join(f'round({c}, 6) {c}' for c in features.FEATURES)} from feats")
def build_features(spark, sf_dir):
    return features.build_features(daily_bars(spark, sf_dir), KEY).select("asset", "bar", *(r(c, 6).alias(c) for c in features.FEATURES))


@query(f"with {BARS} select asset, bar, case when lead(close) over w > close then 1 when lead(close) over w is not null then 0 end target from bars window w as (partition by asset order by bar)")
def target(spark, sf_dir):
    return features.make_target(daily_bars(spark, sf_dir), KEY).select("asset", "bar", "target")


@query(f"with {BARS}, {FEATS}, t as (select *, lead(close) over (partition by asset order by bar) nx from feats) select asset, count(*) n, sum(case when nx > close then 1 else 0 end) ups from t where {' and '.join(f'{c} is not null' for c in features.FEATURES)} and nx is not null group by asset")
def feature_matrix(spark, sf_dir):
    return features.feature_matrix(daily_bars(spark, sf_dir), KEY).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("ups"))


def macd_sql(adjust: bool) -> str:
    return f"""e1 as (select *, {Q.ema('close', 12, adjust)} - ({Q.ema('close', 26, adjust)}) line, {Q.roll('avg', 'close', 200)} ma from bars), e2 as (select *, {Q.ema('line', 9, adjust)} sig from e1),
pos as (select *, {Q.one(Q.above('line', 'sig') + ' and ' + Q.above('close', 'ma'))} position from e2)"""


#: SQL that adds position to the bars of each rule.
POSITION = {
    "macd_200": macd_sql(False),
    "macd_200_adjusted": macd_sql(True),
    "rsi_reversion": f"{RSI}, pos as (select *, {Q.latch(Q.above('30', 'rsi'), Q.above('rsi', '50'))} position from rsis)",
    "donchian_50": f"dc as (select *, {Q.roll('max', 'close', 50)} hi, {Q.roll('min', 'close', 50)} lo from bars), pos as (select *, {Q.latch('close >= hi', 'close <= lo')} position from dc)",
    "reversal_5": f"rv as (select *, close / {Q.prev('close', 5)} - 1 x from bars), pos as (select *, coalesce(-({Q.sgn('x')}), 0) position from rv)",
    "gap_fade": f"rv as (select *, open / {Q.prev('close')} - 1 x from bars), pos as (select *, coalesce(-({Q.sgn('x')}), 0) position from rv)",
    "trend_100": f"mv as (select *, {Q.roll('avg', 'close', 100)} ma from bars), pos as (select *, {Q.one(Q.above('close', 'ma'))} position from mv)",
    "momentum_252": f"mv as (select *, close / {Q.prev('close', 252)} - 1 x from bars), pos as (select *, {Q.one(Q.above('x', '0'))} position from mv)",
    "turn_of_month": f"pos as (select *, {Q.one("row_number() over (partition by asset, date_trunc('month', day) order by bar) <= 2 or row_number() over (partition by asset, date_trunc('month', day) order by bar desc) <= 3")} position from bars)",
    "sell_in_may": f"pos as (select *, {Q.one('month(day) in (11, 12, 1, 2, 3, 4)')} position from bars)",
    "day_of_week": f"pos as (select *, {Q.one('isodow(day) in (2, 3, 4)')} position from bars)",
    "after_down": f"pos as (select *, {Q.one(Q.above(Q.prev('close'), 'close'))} position from bars)",
    "always_long": "pos as (select *, 1.0 as position from bars)",
    "centred": f"cw as (select *, case when count(close) over w = 20 then avg(close) over w end ma from bars window w as (partition by asset order by bar rows between 10 preceding and 9 following)), pos as (select *, {Q.one(Q.above('close', 'ma'))} position from cw)",
    "arbitrary": f"pos as (select *, {Q.one('cast(floor(close * 100) as bigint) % 7 >= 4')} position from bars)",
}
RULES = {
    "macd_200": strategies.macd, "macd_200_adjusted": strategies.macd_adjusted, "rsi_reversion": strategies.rsi_reversion, "donchian_50": strategies.donchian, "reversal_5": strategies.reversal,
    "gap_fade": strategies.gap_fade, "trend_100": strategies.trend, "momentum_252": strategies.momentum, "turn_of_month": strategies.turn_of_month, "sell_in_may": strategies.winter,
    "day_of_week": strategies.mid_week, "after_down": strategies.after_down, "arbitrary": strategies.arbitrary, "always_long": strategies.always_long, "centred": strategies.centred,
}

for _name, _rule in RULES.items():

    def _positions(spark, sf_dir, rule=_rule):
        return rule(daily_bars(spark, sf_dir), KEY).select("asset", "bar", "position")

    QUERIES[f"strategy_{_name}"] = _positions
    SQL[f"strategy_{_name}"] = f"with {BARS}, {POSITION[_name]} select asset, bar, cast(position as double) position from pos"

TREND = f"{BARS}, {POSITION['trend_100']}, p as (select *, {Q.net()} net from pos)"


def trend_net(spark, sf_dir):
    return pnl.strategy_returns(strategies.trend(daily_bars(spark, sf_dir), KEY), KEY)


@query(f"with {TREND} select asset, bar, position, round(net, 10) net from p")
def strategy_net(spark, sf_dir):
    return trend_net(spark, sf_dir).select("asset", "bar", "position", r("net", 10).alias("net"))


@query(f"with {TREND} select asset, count(*) n, round({Q.pf()}, 6) pf, round({Q.sharpe()}, 6) sharpe, round({Q.total()}, 4) ret_pct, round(avg(net) * 1e4, 6) mean_bps, round(stddev_pop(net) * sqrt(252), 6) vol from p group by asset")
def strategy_net_summary(spark, sf_dir):
    return trend_net(spark, sf_dir).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), r(M.profit_factor("net"), 6).alias("pf"), r(M.sharpe("net"), 6).alias("sharpe"), r(M.total_return_pct("net"), 4).alias("ret_pct"), r(M.mean_bps("net"), 6).alias("mean_bps"), r(M.annual_vol("net"), 6).alias("vol")
    )


@query(f"with {TREND}, e as (select *, exp({Q.cum('sum', 'ln(1 + greatest(net, -0.999999))')}) eq from p), k as (select *, eq / {Q.cum('max', 'eq')} - 1 dd from e) select asset, round(min(dd), 8) max_drawdown, round(exp(sum(ln(1 + least(greatest(net, -0.5), 0.5))) * 252 / count(*)) - 1, 8) cagr from k group by asset")
def drawdown(spark, sf_dir):
    d = pnl.drawdown(trend_net(spark, sf_dir), KEY)
    clipped = F.log1p(F.least(F.greatest(F.col("net"), F.lit(-0.5)), F.lit(0.5)))
    return d.groupBy("asset").agg(r(F.min("drawdown"), 8).alias("max_drawdown"), r(F.expm1(F.sum(clipped) * 252 / F.count(F.lit(1))), 8).alias("cagr"))


FOLDS = f"""{BARS}, nn as (select *, count(*) over (partition by asset) n from bars), ff as (select *, least(bar // (n // 6), 5) fold from nn), fb as (select *, bar - min(bar) over (partition by asset, fold) fbar, count(*) over (partition by asset, fold) size from ff),
fm as (select *, {Q.roll('avg', 'close', 100, 'asset, fold')} ma from fb where size >= 10), pos as (select *, {Q.one(Q.above('close', 'ma'))} position from fm), p as (select *, {Q.net('asset, fold')} net from pos),
folds as (select asset, cast(fold as int) fold, {Q.total()} ret_pct, {Q.pf()} pf from p group by asset, fold)"""


@query(f"with {FOLDS} select asset, fold, round(ret_pct, 4) ret_pct, round(pf, 6) pf from folds")
def walk_forward(spark, sf_dir):
    return battery.walk_forward(bars_once(spark, sf_dir), KEY, strategies.trend).select("asset", "fold", r("ret_pct", 4).alias("ret_pct"), r("pf", 6).alias("pf"))


@query(f"with {FOLDS} select asset, count(*) folds, sum(case when ret_pct > 0 then 1 else 0 end) profitable, sum(case when ret_pct > 0 then 1 else 0 end) >= 0.6 * count(*) - 1e-12 passed from folds group by asset")
def walk_forward_gate(spark, sf_dir):
    return battery.gate(battery.walk_forward(bars_once(spark, sf_dir), KEY, strategies.trend), KEY)


@query(f"with {TREND}, g as (select *, least(bar // (count(*) over (partition by asset) // 6), 5) fold from p), h as (select asset, fold, {Q.total()} r, sum(ln(1 + greatest(net, -0.999999))) lg from g group by 1, 2) select asset, sum(case when r > 0 then 1 else 0 end) recent_profitable, round((exp(sum(lg)) - 1) * 100, 4) recent_ret_pct from h where fold >= 3 group by asset")
def recent_consistency(spark, sf_dir):
    d = battery.recent_consistency(trend_net(spark, sf_dir).select("asset", "bar", "net"), KEY)
    return d.select("asset", "recent_profitable", r("recent_ret_pct", 4).alias("recent_ret_pct"))


@query(f"""with {TREND}, m as (select *, {Q.roll('avg', 'close', 50)} ma50 from p), s as (select *, ma50 - {Q.prev('ma50')} sl from m),
g as (select *, case when {Q.above('close', 'ma50')} and {Q.above('sl', '0')} then 'UP' when {Q.above('ma50', 'close')} and {Q.above('0', 'sl')} then 'DOWN' else 'FLAT' end regime from s),
a as (select asset, regime, count(*) n, avg(net) * 1e4 b, {Q.pf()} pf from g group by 1, 2), l as (select distinct asset, unnest(['UP', 'DOWN', 'FLAT']) regime from bars),
o as (select asset, regime, coalesce(n, 0) n, coalesce(b, 0) b, coalesce(pf, 1.0) pf from l left join a using (asset, regime))
select asset, regime, n, round(b, 6) mean_bps, round(pf, 6) pf, max(case when regime = 'UP' then b end) over (partition by asset) > 0 and max(case when regime = 'DOWN' then b end) over (partition by asset) <= 0 beta from o""")
def regime_check(spark, sf_dir):
    d = battery.regime_check(bars_once(spark, sf_dir), KEY, strategies.trend)
    return d.select("asset", "regime", "n", r("mean_bps", 6).alias("mean_bps"), r("pf", 6).alias("pf"), "beta")


@query(f"with {TREND}, mr as (select *, {Q.ret()} rr from bars), m as (select bar, avg(rr) market from mr group by bar), a as (select asset, coalesce(avg(case when market > 0 then net end) * 1e4, 0) u, coalesce(avg(case when market < 0 then net end) * 1e4, 0) d from p join m using (bar) group by asset) select asset, round(u, 6) up_bps, round(d, 6) down_bps, u > 0 and d > 0 neutral, u * d < 0 directional from a")
def market_sign(spark, sf_dir):
    d = battery.market_sign(trend_net(spark, sf_dir).select("asset", "bar", "net"), battery.market_of(daily_bars(spark, sf_dir)), KEY)
    return d.select("asset", r("up_bps", 6).alias("up_bps"), r("down_bps", 6).alias("down_bps"), "neutral", "directional")


def audit_sql(full: str, part: str) -> str:
    """full and part: the position over (partition by asset) and over (partition by asset, cut)."""
    return f"""with {BARS}, n as (select asset, count(*) n from bars group by asset), c as (select distinct asset, cast(floor(55 + i * (n - 1 - 55.0) / 11 + 1e-9) as int) cut from n, range(12) t(i)),
k as (select b.*, c.cut from bars b join c on b.asset = c.asset and b.bar < c.cut), f as (select *, {full} position from bars), p as (select *, {part} position from k)
select p.asset, count(*) cuts, sum(case when p.position is distinct from f.position then 1 else 0 end) mismatches, sum(case when p.position is distinct from f.position then 1 else 0 end) = 0 clean
from p join f on p.asset = f.asset and p.bar = f.bar where p.bar = p.cut - 1 group by p.asset"""


@query(audit_sql(Q.one(Q.above("close", Q.roll("avg", "close", 20))), Q.one(Q.above("close", Q.roll("avg", "close", 20, "asset, cut")))))
def lookahead_audit(spark, sf_dir):
    return battery.lookahead_audit(bars_once(spark, sf_dir), KEY, strategies.sma20)


@query(audit_sql(Q.one(Q.above("lead(close) over (partition by asset order by bar)", "close")), Q.one(Q.above("lead(close) over (partition by asset, cut order by bar)", "close"))))
def lookahead_audit_of_a_leak(spark, sf_dir):
    return battery.lookahead_audit(bars_once(spark, sf_dir), KEY, strategies.peek)


def ids(n: int) -> str:
    return f"(select unnest(range(1, {n + 1})) perm_id)"


def perm_sql(n: int) -> str:
    return f"""{BARS}, lg as (select asset, bar, ln(open) o, ln(high) h, ln(low) l, ln(close) c, {Q.prev('ln(close)')} pc from bars), reps as (select asset, bar, o - pc gap, h - o dh, l - o dl, c - o dc, perm_id from lg, {ids(n)} where bar > 0),
g as (select asset, perm_id, gap, row_number() over (partition by asset, perm_id order by {Q.draw('gap42', 'asset')}) pos from reps),
s as (select asset, perm_id, dh, dl, dc, row_number() over (partition by asset, perm_id order by {Q.draw('shape42', 'asset')}) pos from reps),
ch as (select asset, perm_id, pos, dh, dl, dc, a.c + sum(gap + dc) over (partition by asset, perm_id order by pos) c from g join s using (asset, perm_id, pos) join (select asset, c from lg where bar = 0) a using (asset)),
perm as (select asset, perm_id, cast(pos as int) bar, exp(c - dc) as open, exp(c - dc + dh) high, exp(c - dc + dl) low, exp(c) as close from ch union all select asset, perm_id, 0, exp(o), exp(h), exp(l), exp(c) from lg, {ids(n)} where bar = 0)"""


@query(f"with {perm_sql(5)} select asset, perm_id, bar, {', '.join(f'round({c}, 3) as {c}' for c in ('open', 'high', 'low', 'close'))} from perm")
def permute_prices(spark, sf_dir):
    d = scenarios.permute_prices(daily_bars(spark, sf_dir), KEY, 5)
    return d.select("asset", F.col("perm_id").cast("bigint").alias("perm_id"), "bar", *(r(c, 3).alias(c) for c in ("open", "high", "low", "close")))


@query(f"""with {perm_sql(PRICE_PERM)}, m as (select *, {Q.roll('avg', 'close', 20, 'asset, perm_id')} ma from perm), pos as (select *, {Q.one(Q.above('close', 'ma'))} position from m), pn as (select asset, perm_id, {Q.net('asset, perm_id')} net from pos), ps as (select asset, perm_id, {Q.pf()} score from pn group by 1, 2),
rm as (select *, {Q.roll('avg', 'close', 20)} ma from bars), rp as (select *, {Q.one(Q.above('close', 'ma'))} position from rm), rn as (select asset, {Q.net()} net from rp), rs as (select asset, {Q.pf()} re from rn group by 1),
a as (select asset, max(re) re, avg(score) pm, quantile_cont(score, 0.95) p95, count(*) n, (1 + sum(case when score >= re - 1e-12 then 1 else 0 end)) / (1 + count(*)) pv from ps join rs using (asset) group by 1)
select asset, round(re, 6) as "real", round(pm, 6) perm_mean, round(p95, 6) perm_p95, n n_perm, round(pv, 6) p_value, case when pv < 0.01 then 'REAL' when pv < 0.05 then 'SUSPECT' else 'NOISE' end verdict from a""")
def mcpt(spark, sf_dir):
    return rounded(battery.mcpt(bars_once(spark, sf_dir), KEY, strategies.sma20, n_perm=PRICE_PERM), 6)


@query(f"""with {TREND}, reps as (select asset, bar, perm_id, case when {Q.draw('sign42', 'asset')} < 2147483648 then net else -net end net from p, {ids(PRICE_PERM)}), ps as (select asset, perm_id, {Q.pf()} score from reps group by 1, 2), rs as (select asset, {Q.pf()} pf from p group by 1)
select asset, round(max(pf), 6) pf, count(*) n_perm, round((1 + sum(case when score >= pf - 1e-12 then 1 else 0 end)) / (1 + count(*)), 6) p_value from ps join rs using (asset) group by asset""")
def sign_flip(spark, sf_dir):
    return rounded(battery.sign_flip(trend_net(spark, sf_dir), KEY, PRICE_PERM), 6)


@query(f"""with {BARS}, rr as (select asset, bar, {Q.ret()} today from bars), t as (select asset, bar, today, lead(today) over (partition by asset order by bar) tomorrow from rr), v as (select * from t where tomorrow is not null and today < 0),
pl as (select asset, perm_id, bar, today, row_number() over (partition by asset, perm_id order by bar) pos from v, {ids(REGIME_PERM)}),
dr as (select asset, perm_id, tomorrow, row_number() over (partition by asset, perm_id order by {Q.draw('value0', 'asset')}) pos from v, {ids(REGIME_PERM)}),
ps as (select asset, perm_id, corr(today, tomorrow) score from pl join dr using (asset, perm_id, pos) group by 1, 2), rs as (select asset, count(*) n, corr(today, tomorrow) re from v group by 1)
select asset, max(n) n, round(max(re), 6) autocorr, round((1 + sum(case when abs(score) >= abs(re) - 1e-12 then 1 else 0 end)) / (1 + count(*)), 6) p_value from ps join rs using (asset) group by asset""")
def regime_autocorr(spark, sf_dir):
    d = daily_bars(spark, sf_dir).withColumn("today", W.bar_return("close", KEY)).withColumn("tomorrow", W.lag("today", KEY, -1))
    v = d.where("tomorrow is not null and today < 0").select("asset", "bar", "today", "tomorrow")
    return rounded(battery.regime_autocorr(v, KEY, REGIME_PERM), 6)


GRID = ("macd_200_adjusted", "rsi_reversion", "donchian_50", "reversal_5", "gap_fade", "trend_100")


def _grid_sql() -> str:
    names = {"macd_200_adjusted": "macd_200"}
    parts = [f"select '{names.get(g, g)}' strategy, asset, net from (with {POSITION[g]} select asset, {Q.net()} net from pos)" for g in GRID]
    return f"with {BARS}, g as ({' union all '.join(parts)}) select strategy, asset, round({Q.total()}, 4) ret_pct, round({Q.pf()}, 6) pf from g group by 1, 2"


@query(_grid_sql())
def strategy_grid(spark, sf_dir):
    g = pnl.strategy_returns(strategies.grid(bars_once(spark, sf_dir)), ["strategy", "asset"])
    return g.groupBy("strategy", "asset").agg(r(M.total_return_pct("net"), 4).alias("ret_pct"), r(M.profit_factor("net"), 6).alias("pf"))


@query(f"""with {BARS}, x as (select asset, bar, open / nullif({Q.prev('close')}, 0) - 1 ov, close / nullif(open, 0) - 1 it from bars), y as (select asset, coalesce(ov, 0) ov, coalesce(it, 0) it from x)
select asset, round({Q.total('ov')}, 4) overnight_gross, round({Q.total('ov - 2 * 0.0003')}, 4) overnight_net, round({Q.total('it')}, 4) intraday_gross, round({Q.total('ov - it - 4 * 0.0003')}, 4) difference_net from y group by asset""")
def overnight_split(spark, sf_dir):
    d = daily_bars(spark, sf_dir)
    d = d.select("asset", F.coalesce(F.try_divide("open", W.lag("close", KEY)) - 1, F.lit(0.0)).alias("ov"), F.coalesce(F.try_divide("close", "open") - 1, F.lit(0.0)).alias("it"))
    night = pnl.round_trip_returns(d, "ov").withColumnRenamed("net", "ov_net").withColumn("diff", F.col("ov") - F.col("it"))
    d = pnl.round_trip_returns(night, "diff", turns=2.0)
    return d.groupBy("asset").agg(*(r(M.total_return_pct(c), 4).alias(n) for c, n in (("ov", "overnight_gross"), ("ov_net", "overnight_net"), ("it", "intraday_gross"), ("net", "difference_net"))))


@query(f"with {HOURS} select asset, count(*) n, round(avg(close), 6) mean_close, round(avg(high - low), 6) mean_range, round({Q.total('r')}, 4) ret_pct from (select *, {Q.ret()} r from bars) group by asset")
def hourly_summary(spark, sf_dir):
    d = hourly_bars(spark, sf_dir).withColumn("r", W.bar_return("close", KEY))
    return d.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), r(F.avg("close"), 6).alias("mean_close"), r(F.avg(F.col("high") - F.col("low")), 6).alias("mean_range"), r(M.total_return_pct("r"), 4).alias("ret_pct"))


LEDGER = f"with {BARS}, t as (select asset as name, (bar % 97 + 1) / 5000.0 p_value, close total_return from bars)"


@query(f"{LEDGER}, n as (select count(*) n from t) select n n_trials, round(0.05 / n, 12) corrected_bar, round(n * 0.01, 6) expected_false, count(case when p_value < 0.01 then 1 end) naive_passes, count(case when p_value < 0.05 / n then 1 end) corrected_passes, coalesce(string_agg(case when p_value < 0.05 / n then name end, ',' order by p_value, name), '') survivors from t, n group by n")
def ledger_assess(spark, sf_dir):
    t = daily_bars(spark, sf_dir).select(F.col("asset").alias("name"), ((F.col("bar") % 97 + 1) / 5000.0).alias("p_value"), F.col("close").alias("total_return"))
    d = ledger.assess(t)
    return d.withColumns({"corrected_bar": r("corrected_bar", 12), "expected_false": r("expected_false", 6)})


def verdict_sql(rules: dict[str, str], n: int) -> str:
    """CTEs up to v (strategy, asset, real, p_value, folds, profitable, passed, mismatches, clean, beta): every scenario of an
    asset is an asset of its own, named asset#scenario#number, so that the positions of POSITION run over all of them."""
    runs = " union all ".join(f"select '{name}' strategy, asset, bar, position, net from (with {sql} select asset, bar, position, {Q.net()} net from pos)" for name, sql in rules.items())
    return f"""with sc as materialized (with {perm_sql(n)}, nn as (select *, count(*) over (partition by asset) n from bars), ff as (select *, cast(least(bar // (n // 6), 5) as int) fold from nn),
 fb as (select *, bar - min(bar) over (partition by asset, fold) fbar, count(*) over (partition by asset, fold) size from ff), cn as (select asset, count(*) n from bars group by asset),
 cp as (select distinct asset, cast(floor(55 + i * (n - 1 - 55.0) / 11 + 1e-9) as int) lim from cn, range(12) t(i)),
 rg as (select *, {Q.roll('avg', 'close', 50)} ma from bars), rs as (select *, ma - {Q.prev('ma')} sl from rg),
 rx as (select *, case when {Q.above('close', 'ma')} and {Q.above('sl', '0')} then 'UP' when {Q.above('ma', 'close')} and {Q.above('0', 'sl')} then 'DOWN' else 'FLAT' end regime from rs)
 select asset || '#perm#' || perm_id asset, bar, open, high, low, close, null regime from perm union all select asset || '#real#0', bar, open, high, low, close, regime from rx
 union all select asset || '#fold#' || fold, cast(fbar as int), open, high, low, close, null from fb where size >= 10 union all select b.asset || '#cut#' || lim, b.bar, open, high, low, close, null from bars b join cp on b.asset = cp.asset and b.bar < cp.lim),
bars as (select asset, bar, open, high, low, close from sc), g as materialized ({runs}), h as (select strategy, split_part(g.asset, '#', 1) asset, split_part(g.asset, '#', 2) kind, split_part(g.asset, '#', 3) num, g.bar, position, net, regime from g left join sc on sc.asset = g.asset and sc.bar = g.bar and g.asset like '%#real#0'),
s as (select strategy, asset, kind, num, {Q.pf()} pf, {Q.total()} ret, max(bar) lastbar, arg_max(position, bar) pos, coalesce(avg(net) filter (regime = 'UP'), 0) u, coalesce(avg(net) filter (regime = 'DOWN'), 0) d from h group by 1, 2, 3, 4),
re as (select strategy, asset, pf as real, u > 0 and d <= 0 beta from s where kind = 'real'),
pe as (select strategy, asset, (1 + sum(case when pf >= real - 1e-12 then 1 else 0 end)) / (1 + count(*)) p_value from s join re using (strategy, asset) where kind = 'perm' group by 1, 2),
fo as (select strategy, asset, count(*) folds, cast(sum(case when ret > 0 then 1 else 0 end) as bigint) profitable from s where kind = 'fold' group by 1, 2),
au as (select s.strategy, s.asset, cast(sum(case when s.pos is distinct from f.position then 1 else 0 end) as bigint) mismatches from s join h f on f.kind = 'real' and f.strategy = s.strategy and f.asset = s.asset and f.bar = s.lastbar where s.kind = 'cut' group by 1, 2),
v as (select *, profitable >= 0.6 * folds - 1e-12 passed, mismatches = 0 clean from re join pe using (strategy, asset) join fo using (strategy, asset) join au using (strategy, asset))"""


@query(f"""{verdict_sql({'reversal_5': POSITION['reversal_5']}, PRICE_PERM)} select asset, clean, mismatches, round(real, 6) as "real", round(p_value, 6) p_value, case when p_value < 0.01 then 'REAL' when p_value < 0.05 then 'SUSPECT' else 'NOISE' end verdict,
 folds, profitable, passed, beta, clean and p_value < 0.01 and passed survives from v""")
def full_gauntlet(spark, sf_dir):
    return rounded(battery.full_gauntlet(bars_once(spark, sf_dir), KEY, strategies.reversal, n_perm=PRICE_PERM), 6)


GRID_RULES = {{"macd_200_adjusted": "macd_200"}.get(g, g): POSITION[g] for g in GRID}


@query(f"""{verdict_sql(GRID_RULES, GRID_PERM)}, n as (select count(*) c from v)
select strategy, asset, round(real, 6) pf, round(p_value, 6) p_value, beta, passed, clean, p_value < 0.05 and passed and clean raw_sig, p_value < 0.05 / c and passed and clean and not beta corrected_sig from v, n""")
def grid_verdicts(spark, sf_dir):
    return rounded(battery.grid_verdicts(bars_once(spark, sf_dir), strategies.REGISTRY, KEY, n_perm=GRID_PERM), 6)
