"""Queries of calibration, volatility, regimes, panels, factors and correlation structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import windows as W
from tidemark.operators import asof, battery, calibration, features, logistic, panels, pnl, regimes, structure, volatility
from tidemark.plans import sql as Q
from tidemark.plans.inputs import BARS, FILED, FORECASTS, PANEL, bars_once, daily_bars, forecasts, order_filings, weekly_panel
from tidemark.plans.market import KEY, PANEL_PERM, REGIME_PERM, ids, perm_sql, r, rounded
from tidemark.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


BIN = "case when prob >= 0.9 and prob <= 1.0 then 9 " + " ".join(f"when prob >= {i / 10!r} and prob < {(i + 1) / 10!r} then {i}" for i in range(9)) + " end"
BINNED = f"with {FORECASTS}, b as (select *, {BIN} bin from f), per as (select bin, count(*) n, avg(prob) p, avg(outcome) o from b where bin is not null group by bin)"
MURPHY = f"{BINNED}, t as (select sum(n) nt, sum(n * o) / sum(n) base from per), m as (select max(nt) n, max(base) base_rate, sum(n * (p - o) * (p - o)) / max(nt) reliability, sum(n * (o - base) * (o - base)) / max(nt) resolution, max(base) * (1 - max(base)) uncertainty, sum(n * abs(p - o)) / max(nt) ece from per, t)"


@query(f"with {FORECASTS} select round(avg((prob - outcome) * (prob - outcome)), 8) brier from f")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.both(forecasts(spark, sf_dir)).agg(r(M.brier("prob", "outcome")).alias("brier"))


@query(f"{BINNED} select i bin, i / 10.0 lo, (i + 1) / 10.0 hi, coalesce(n, 0) n, round(p, 8) mean_prob, round(o, 8) freq from range(10) r(i) left join per on bin = i")
def reliability(spark, sf_dir):
    return rounded(calibration.reliability(forecasts(spark, sf_dir)))


@query(f"{MURPHY} select n, round(base_rate, 8) base_rate, round(reliability, 8) reliability, round(resolution, 8) resolution, round(uncertainty, 8) uncertainty, round(ece, 8) ece, round(reliability - resolution + uncertainty, 8) recombined from m")
def murphy(spark, sf_dir):
    return rounded(calibration.murphy(forecasts(spark, sf_dir)))


@query(f"{MURPHY} select round(ece, 8) ece from m")
def ece(spark, sf_dir):
    return rounded(calibration.expected_calibration_error(forecasts(spark, sf_dir)))


@query(f"{MURPHY}, s as (select avg((prob - outcome) * (prob - outcome)) brier, var_pop(outcome) brier_base from f) select 'discount' as label, n, round(brier, 8) brier, round(brier_base, 8) brier_base, round(1 - brier / brier_base, 8) skill, round(ece, 8) ece from m, s")
def calibration_report(spark, sf_dir):
    return rounded(calibration.calibration_report(forecasts(spark, sf_dir), label="discount").select("label", "n", "brier", "brier_base", "skill", "ece"))


def returns(spark, sf_dir):
    return daily_bars(spark, sf_dir).withColumn("ret", W.bar_return("close", KEY)).select("asset", "bar", "close", "ret")


def _ewma_sql(train: int) -> str:
    past = f"over (partition by asset order by bar rows between {train} preceding and 1 preceding)"
    return f"""{BARS}, r as (select asset, bar, close, {Q.ret()} ret from bars), v as (select *, pow(0.94, {train}) * var_pop(ret) over (partition by asset order by bar rows between {train} preceding and {train - 19} preceding) start, list(ret) {past} past from r),
w as (select asset, bar, ret, case when bar >= {train} then start + 0.06 * list_sum(list_transform(past, lambda x, i: x * x * pow(0.94, {train} - i))) end ewma, var_pop(ret) over (partition by asset order by bar rows between 21 preceding and 1 preceding) naive,
case when count(ret) over (partition by asset order by bar rows between current row and 20 following) = 21 then var_pop(ret) over (partition by asset order by bar rows between current row and 20 following) end realized from v)"""


VOL = f"{_ewma_sql(504)}, fc as (select asset, bar, realized, unnest(['naive', 'ewma']) as method, unnest([naive, ewma]) forecast from w where bar >= 504 and (bar - 504) % 21 = 0 and realized is not null)"


@query(f"with {VOL} select asset, bar, method, round(forecast, 10) forecast, round(realized, 10) realized from fc")
def walk_forward_vol(spark, sf_dir):
    return rounded(volatility.walk_forward_vol(returns(spark, sf_dir), KEY), 10)


@query(f"""with {VOL}, e as (select asset, method, count(*) n, avg(case when forecast > 1e-12 and realized > 1e-12 then realized / forecast - ln(realized / forecast) - 1 end) q, sqrt(avg((forecast - realized) * (forecast - realized))) rmse, {Q.corr('sqrt(forecast)', 'sqrt(realized)')} vol_corr from fc group by 1, 2)
select asset, method, n, round(q, 8) qlike, round(rmse, 8) rmse, round(vol_corr, 8) vol_corr, round((max(case when method = 'naive' then q end) over (partition by asset) - q) / nullif(max(case when method = 'naive' then q end) over (partition by asset), 0), 8) gain from e""")
def vol_eval(spark, sf_dir):
    return rounded(volatility.evaluate_vol(volatility.walk_forward_vol(returns(spark, sf_dir), KEY), KEY))


TARGET = f"""{_ewma_sql(504)}, d as (select asset, bar, ret, case when bar >= 504 and (bar % 5 = 0 or bar = 504) then least(0.15 / sqrt(252) / nullif(sqrt(ewma), 0), 2.0) end x from w), g as (select asset, bar, ret, coalesce({Q.held('x')}, 0) weight from d)"""


@query(f"with {TARGET} select asset, bar, round(weight, 8) weight from g")
def vol_target(spark, sf_dir):
    return rounded(volatility.vol_target_weights(returns(spark, sf_dir), KEY).select("asset", "bar", "weight"))


@query(f"""with {TARGET}, h as (select *, coalesce({Q.prev('weight')}, 0) pw from g), o as (select asset, bar, unnest(['hold', 'target']) overlay, unnest([ret, pw * ret - abs(weight - pw) * 0.0003]) net from h where bar >= 504),
q as (select *, {Q.cum('sum', 'ln(1 + greatest(net, -0.999999))', 'asset, overlay')} eq, {Q.roll('stddev_samp', 'net', 63, 'asset, overlay')} rv from o), z as (select *, exp(eq - {Q.cum('max', 'eq', 'asset, overlay')}) - 1 dd from q)
select asset, overlay, round(case when coalesce(stddev_pop(net), 0) <= 1e-12 then 0 else avg(net) / stddev_pop(net) * sqrt(252) end, 6) sharpe, round(stddev_pop(net) * sqrt(252), 6) vol, round(min(dd), 8) max_drawdown, round(stddev_samp(rv) / avg(rv), 6) vol_cv from z group by 1, 2""")
def vol_target_report(spark, sf_dir):
    d = volatility.vol_target_report(returns(spark, sf_dir), KEY)
    return d.select("asset", "overlay", r("sharpe", 6).alias("sharpe"), r("vol", 6).alias("vol"), r("max_drawdown").alias("max_drawdown"), r("vol_cv", 6).alias("vol_cv"))


@query()
def garch(spark, sf_dir):
    return volatility.walk_forward_vol(returns(spark, sf_dir), KEY, methods=("naive", "garch"))


@query()
def vol_eval_garch(spark, sf_dir):
    """The evaluation of all three methods; vol_eval has the two that SQL can state."""
    return volatility.evaluate_vol(volatility.walk_forward_vol(returns(spark, sf_dir), KEY, methods=("naive", "ewma", "garch")), KEY)


def models(spark, sf_dir, k=2, train=1.0):
    return regimes.fit_models(returns(spark, sf_dir).where("bar > 0"), KEY, k=k, train=train)


@query()
def hmm_fit(spark, sf_dir):
    return models(spark, sf_dir)


@query()
def hmm_describe(spark, sf_dir):
    return regimes.describe(models(spark, sf_dir), KEY)


@query()
def hmm_filter(spark, sf_dir):
    return regimes.label(returns(spark, sf_dir), models(spark, sf_dir, 3, 0.4), KEY)


@query()
def hmm_smooth(spark, sf_dir):
    return regimes.label(returns(spark, sf_dir), models(spark, sf_dir), KEY, how="smooth")


@query()
def viterbi(spark, sf_dir):
    return regimes.label(returns(spark, sf_dir), models(spark, sf_dir), KEY, how="viterbi")


def sized(bars: DataFrame) -> DataFrame:
    """Regimes that SQL can reproduce: 2 where the last 20 returns vary by more than 1.2 times the asset's median of that."""
    d = bars.withColumn("__sd", W.roll_std("ret", 20, KEY))
    med = d.groupBy("asset").agg(F.median("__sd").alias("__m"))
    return d.join(med, "asset").select("asset", "bar", "ret", F.when(F.col("__sd") > 1.2 * F.col("__m"), 2).when(F.col("__sd") > F.col("__m"), 1).otherwise(0).alias("regime"))


SIZED = f"{BARS}, r as (select asset, bar, {Q.ret()} ret from bars), s as (select *, {Q.roll('stddev_samp', 'ret', 20)} sd from r), md as (select asset, median(sd) m from s group by asset), lab as (select asset, bar, ret, case when sd > 1.2 * m then 2 when sd > m then 1 else 0 end regime from s join md using (asset))"


@query(f"with {SIZED}, n as (select *, lead(ret) over (partition by asset order by bar) nx from lab) select asset, regime, count(*) n, round(avg(case when nx > 0 then 1.0 else 0.0 end), 8) up_rate, round(abs(avg(case when nx > 0 then 1.0 else 0.0 end) - 0.5), 8) edge from n where nx is not null group by 1, 2 having count(*) >= 50")
def direction_by_regime(spark, sf_dir):
    return rounded(regimes.direction_by_regime(sized(returns(spark, sf_dir)), KEY))


@query(f"""with {SIZED}, p as (select asset, bar, ret, case when {Q.prev('regime')} = 2 then -sign({Q.prev('ret')}) else 0 end as position from lab), f as (select asset, position * ret - abs(position - coalesce({Q.prev('position')}, 0)) * 0.0003 net, position from p)
select asset, round({Q.total()}, 4) ret_pct, round({Q.pf()}, 6) pf, sum(case when position <> 0 then 1 else 0 end) active from f group by asset""")
def crisis_fade(spark, sf_dir):
    d = pnl.prelagged_returns(regimes.crisis_fade(sized(returns(spark, sf_dir)), KEY, 2), KEY, "ret")
    return d.groupBy("asset").agg(r(M.total_return_pct("net"), 4).alias("ret_pct"), r(M.profit_factor("net"), 6).alias("pf"), F.sum((F.col("position") != 0).cast("int")).alias("active"))


@query()
def conditioned_vol(spark, sf_dir):
    ret = returns(spark, sf_dir)
    m = regimes.fit_models(ret.where("bar > 0"), KEY, k=3, train=0.5)
    return regimes.conditioned_vol(regimes.label(ret, m, KEY), m, volatility.walk_forward_vol(ret, KEY), KEY)


@query()
def walk_forward_logit(spark, sf_dir):
    return logistic.walk_forward_proba(features.feature_matrix(daily_bars(spark, sf_dir), KEY), KEY)


@query()
def logit_calibration(spark, sf_dir):
    return calibration.calibration_report(walk_forward_logit(spark, sf_dir), label="walk_forward")


def panel(spark, sf_dir):
    """The weekly panel, derived once: every query on it reads it in several branches."""
    return cut(panels.build_panel(cut(weekly_panel(spark, sf_dir)), "week"))


FULL = f"""{PANEL}, dn as (select wkd, count(distinct asset) n from panel group by wkd), wk as (select wkd, cast(row_number() over (order by wkd) - 1 as int) bar from dn where wkd >= (select min(wkd) from dn where n >= 10)),
fa as (select asset from panel join wk using (wkd) group by asset having count(*) = (select count(*) from wk)), pnl0 as (select asset, bar, close from panel join wk using (wkd) join fa using (asset))"""


@query(f"with {FULL} select asset, count(*) n, max(bar) last_bar, round(avg(close), 4) mean_close from pnl0 group by asset")
def build_panel(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.max("bar").alias("last_bar"), r(F.avg("close"), 4).alias("mean_close"))


def _xs_cte(kind: str) -> str:
    return _xs_sql(SCORES[kind][0]).removeprefix(f"{FULL}, ")


def _xs_sql(score: str) -> str:
    """score over pnl0 rows as x."""
    return f"""{FULL}, x0 as (select *, {Q.ret()} ret, close / {Q.prev('close')} - 1 r0 from pnl0), x1 as (select *, {score} score from x0),
x2 as (select *, count(score) over (partition by bar) n, row_number() over (partition by bar order by score desc nulls last, asset desc) b, row_number() over (partition by bar order by score asc nulls last, asset asc) w from x1),
x3 as (select *, case when bar % 21 = 0 and bar > 0 and n >= 10 then case when score is null then 0 when b <= 5 then 0.2 when w <= 5 then -0.2 else 0 end end x from x2), x4 as (select asset, bar, ret, coalesce({Q.held('x')}, 0) weight from x3),
x5 as (select bar, coalesce({Q.prev('weight')}, 0) * ret - abs(weight - coalesce({Q.prev('weight')}, 0)) * 0.0003 leg from x4), xs as (select bar, sum(leg) net from x5 group by bar)"""


SCORES = {
    "momentum": (f"{Q.prev('close', 4)} / {Q.prev('close', 30)} - 1", dict(kind="momentum", lookback=26, skip=4)),
    "reversal": (f"-(close / {Q.prev('close', 4)} - 1)", dict(kind="reversal", lookback=4)),
    "lowvol": (f"-({Q.roll('stddev_samp', 'r0', 12)})", dict(kind="lowvol", lookback=12)),
}
for _n, (_s, _o) in SCORES.items():

    def _xs(spark, sf_dir, o=_o):
        return rounded(panels.xs_portfolio(panel(spark, sf_dir), k=5, **o), 10)

    QUERIES[f"xs_{_n}"] = _xs
    SQL[f"xs_{_n}"] = f"with {_xs_sql(_s)} select bar, round(net, 10) net from xs"


def shuffled_sql(source: str, keep: str) -> str:
    """CTEs up to sh (asset, bar, perm_id, ret, keep): the returns of source shuffled within each asset."""
    return f"""rp as (select * from {source}, {ids(PANEL_PERM)}), rows_at as (select asset, perm_id, bar, {keep} row_number() over (partition by asset, perm_id order by bar) pos from rp),
dr as (select asset, perm_id, ret, row_number() over (partition by asset, perm_id order by {Q.draw('value42', 'asset')}) pos from rp), sh as (select * from rows_at join dr using (asset, perm_id, pos))"""


def p_sql(real: str, permuted: str) -> str:
    """The last select: real has the column net, permuted net and perm_id."""
    return f"""ps as (select perm_id, {Q.pf()} score from {permuted} group by 1), rl as (select {Q.pf()} re from {real}) select round(max(re), 6) as "real", count(*) n_perm, round((1 + sum(case when score >= re - 1e-12 then 1 else 0 end)) / (1 + count(*)), 6) p_value from ps, rl"""


@query(f"""with {_xs_sql(SCORES['reversal'][0])}, {shuffled_sql('x0', '')}, q0 as (select asset, perm_id, bar, exp({Q.cum('sum', 'ln(1 + ret)', 'asset, perm_id')}) * 100 as close from sh),
q1 as (select *, {Q.ret('asset, perm_id')} ret, -(close / {Q.prev('close', 4, 'asset, perm_id')} - 1) score from q0),
q2 as (select *, count(score) over (partition by perm_id, bar) n, row_number() over (partition by perm_id, bar order by score desc nulls last, asset desc) b, row_number() over (partition by perm_id, bar order by score asc nulls last, asset asc) w from q1),
q3 as (select *, case when bar % 21 = 0 and bar > 0 and n >= 10 then case when score is null then 0 when b <= 5 then 0.2 when w <= 5 then -0.2 else 0 end end x from q2), q4 as (select asset, perm_id, bar, ret, coalesce({Q.held('x', 'asset, perm_id')}, 0) weight from q3),
q5 as (select perm_id, bar, coalesce({Q.prev('weight', 1, 'asset, perm_id')}, 0) * ret - abs(weight - coalesce({Q.prev('weight', 1, 'asset, perm_id')}, 0)) * 0.0003 leg from q4), q6 as (select perm_id, bar, sum(leg) net from q5 group by 1, 2), {p_sql('xs', 'q6')}""")
def xs_permuted(spark, sf_dir):
    return rounded(panels.xs_permuted(panel(spark, sf_dir), "reversal", 4, 5, PANEL_PERM), 6)


PAIRS = f"""{FULL}, nm as (select distinct asset from pnl0), pr as (select asset, bar, close, {Q.ret()} ret from pnl0 where asset in (select asset from nm)),
pj as (select a.asset asset_a, b.asset asset_b, a.bar, ln(a.close) - ln(b.close) x, a.ret ret_a, b.ret ret_b from pr a join pr b on a.bar = b.bar and a.asset < b.asset), sp as (select *, x - avg(x) over (partition by asset_a, asset_b) spread from pj),
zz as (select *, (spread - {Q.roll('avg', 'spread', 30, 'asset_a, asset_b')}) / nullif({Q.roll('stddev_samp', 'spread', 30, 'asset_a, asset_b')}, 0) z from sp), ps as (select *, case when {Q.above('z', '2')} then -1.0 when {Q.above('-2', 'z')} then 1.0 else 0.0 end as position from zz),
pn as (select *, coalesce({Q.prev('position', 1, 'asset_a, asset_b')}, 0) * (ret_a - ret_b) - coalesce(abs(position - {Q.prev('position', 1, 'asset_a, asset_b')}), 0) * 0.0006 net, count(*) over (partition by asset_a, asset_b) n from ps)"""


@query(f"with {PAIRS} select asset_a, asset_b, bar, round(spread, 8) spread, position, round(net, 10) net from pn")
def pairs_pnl(spark, sf_dir):
    k = ["asset_a", "asset_b"]
    from tidemark.operators.strategies import spread_reversion

    d = pnl.pair_returns(spread_reversion(panels.pair_frames(panel(spark, sf_dir)), k), k)
    return d.select(*k, "bar", r("spread").alias("spread"), "position", r("net", 10).alias("net"))


@query(f"""with {PAIRS}, t as (select asset_a, asset_b, {Q.total()} ret_pct, {Q.pf()} pf from pn group by 1, 2), f as (select asset_a, asset_b, least(bar // (n // 6), 5) fold, {Q.total()} r from pn group by 1, 2, 3), c as (select asset_a, asset_b, sum(case when r > 0 then 1 else 0 end) k from f where fold >= 3 group by 1, 2)
select asset_a, asset_b, round(ret_pct, 4) ret_pct, round(pf, 6) pf, k recent_profitable from t join c using (asset_a, asset_b)""")
def pairs_scan(spark, sf_dir):
    d = panels.pairs_scan(panel(spark, sf_dir))
    return d.select("asset_a", "asset_b", r("ret_pct", 4).alias("ret_pct"), r("pf", 6).alias("pf"), "recent_profitable")


DAILY_PAIRS = PAIRS.replace(FULL, BARS.replace("bars as", "b1 as")).replace("pnl0", "b1")


@query(f"""with {DAILY_PAIRS}, t as (select asset_a, asset_b, {Q.total()} ret_pct, sum(case when position <> 0 then 1 else 0 end) active from pn group by 1, 2 having sum(case when position <> 0 then 1 else 0 end) >= 50),
fd as (select asset_a, asset_b, least(bar // (n // 6), 5) fold, {Q.total()} r, sum(ln(1 + greatest(net, -0.999999))) lg from pn group by 1, 2, 3), rc as (select asset_a, asset_b, sum(case when r > 0 then 1 else 0 end) k, (exp(sum(lg)) - 1) * 100 rr from fd where fold >= 3 group by 1, 2),
bars as (select asset_a || '|' || asset_b asset, cast(row_number() over (partition by asset_a, asset_b order by bar) - 1 as int) bar, 100 * exp(spread) as open, 100 * exp(spread) high, 100 * exp(spread) low, 100 * exp(spread) as close from sp join t using (asset_a, asset_b)),
{perm_sql(PANEL_PERM).removeprefix(BARS + ", ")}, al as (select asset, perm_id, bar, close from perm union all select asset, 0, bar, close from bars), l1 as (select *, ln(close) x from al),
l2 as (select *, (x - {Q.roll('avg', 'x', 30, 'asset, perm_id')}) / nullif({Q.roll('stddev_samp', 'x', 30, 'asset, perm_id')}, 0) z from l1), l3 as (select *, case when {Q.above('z', '2')} then -1.0 when {Q.above('-2', 'z')} then 1.0 else 0.0 end as position from l2),
l4 as (select asset, perm_id, {Q.net('asset, perm_id')} net from l3), l5 as (select asset, perm_id, {Q.pf()} score from l4 group by 1, 2), l6 as (select a.asset, (1 + sum(case when a.score >= b.score - 1e-12 then 1 else 0 end)) / (1 + count(*)) pv from l5 a join l5 b on a.asset = b.asset and b.perm_id = 0 where a.perm_id > 0 group by 1), tn as (select count(*) m from t)
select t.asset_a, t.asset_b, active, round(ret_pct, 6) ret_pct, k recent_profitable, round(rr, 6) recent_ret_pct, round(pv, 6) p_value, round(0.05 / m, 6) corrected_bar, k = 3 and rr > 0 and pv < 0.05 / m candidate from t join rc using (asset_a, asset_b) join l6 on l6.asset = t.asset_a || '|' || t.asset_b, tn""")
def pairs_verdicts(spark, sf_dir):
    """All pairs of the daily bars; the weekly panel's pairs have too few bars in a position."""
    return rounded(panels.pairs_verdicts(bars_once(spark, sf_dir).select("asset", "bar", "close"), n_perm=PANEL_PERM), 6)


@query(f"""with {BARS}, x as (select asset, bar, {Q.ret()} ret, close / {Q.prev('close', 252)} - 1 past from bars where asset in ('AF', 'NO')), d as (select a.bar, a.ret ra, b.ret rb, a.past pa, b.past pb, 1 as one from x a join x b on a.bar = b.bar and a.asset = 'AF' and b.asset = 'NO'),
e as (select *, case when bar % 21 = 0 and bar >= 252 then case when pa is not null and pb is not null and pa > 0 and pa >= pb then 'AF' when pa is not null and pb is not null then 'NO' end end pick from d), h as (select *, {Q.held('pick', 'one')} held from e), k as (select *, {Q.prev('held', 1, 'one')} ph from h)
select bar, held, round(case when ph = 'AF' then ra when ph = 'NO' then rb else 0 end - case when ph is not null and held <> ph then 0.0003 else 0 end, 10) net from k""")
def dual_momentum(spark, sf_dir):
    return rounded(panels.dual_momentum(daily_bars(spark, sf_dir), "AF", "NO"), 10)


@query(f"""with {FULL}, x as (select asset, bar, {Q.ret()} ret, close / {Q.prev('close')} - 1 r0 from pnl0), y as (select *, {Q.roll('stddev_samp', 'r0', 26)} sd from x), z as (select *, case when sd > 0 then 1 / sd end i from y),
q as (select *, case when bar % 13 = 0 and bar > 0 and count(i) over (partition by bar) = count(*) over (partition by bar) then i / sum(i) over (partition by bar) end w from z) select asset, bar, round(coalesce({Q.held('w')}, 0), 8) weight from q""")
def inverse_vol(spark, sf_dir):
    return rounded(panels.inverse_vol(panel(spark, sf_dir), 26, 13).select("asset", "bar", "weight"))


@query(f"""with {FILED}, m as (select distinct ticker, cast(last_day(date_filed) as date) t from filings) select m.ticker, cast(m.t as varchar) t, arg_max(f.id, (f.date_filed, f.id)) id, round(arg_max(f."value", (f.date_filed, f.id)), 4) as "value"
from m join filings f on f.ticker = m.ticker and f.date_filed <= m.t group by 1, 2""")
def asof_factors(spark, sf_dir):
    f = order_filings(spark, sf_dir).withColumn("known_from", F.col("date_filed").cast("timestamp"))
    e = f.select("ticker", F.last_day("date_filed").alias("t")).distinct()
    e = e.withColumns({"event_id": F.xxhash64("ticker", "t"), "event_ts": F.col("t").cast("timestamp")})
    d = asof.known_at(f, e, "ticker", "known_from", ["date_filed", "id"], "event_id", "event_ts", ["id", "value"])
    return d.select("ticker", F.to_date("event_ts").cast("string").alias("t"), F.col("known_id").alias("id"), r("known_value", 4).alias("value"))


def snapshots(spark, sf_dir):
    """Quarterly snapshots of the filings of the largest tickers: the mean of each figure per ticker and period."""
    from tidemark.functions.clean import genuine_pe, number
    from tidemark.operators.filings import distinct_filings
    from tidemark.sources.tables import table

    f = distinct_filings(table(spark, sf_dir, "fundamentals"), ["fiscal_period", "pe", "pb", "roe", "gross_margin"])
    return f.groupBy("fiscal_period", "ticker").agg(F.avg(genuine_pe()).alias("pe"), F.avg(number("pb")).alias("pb"), F.avg(number("roe")).alias("roe"), F.avg(number("gross_margin")).alias("gross_margin"))


SNAPS = """fl as (select filing_id, upper(trim(min(ticker))) ticker, min(fiscal_period) fiscal_period, min(pe) pe, min(pb) pb, min(roe) roe, min(gross_margin) gross_margin from fundamentals where filing_id is not null and ticker is not null group by filing_id),
sn as (select fiscal_period, ticker, avg(case when not isnan(pe) and pe <> 0 and abs(pe) < 500 then pe end) pe, avg(case when not isnan(pb) then pb end) pb, avg(case when not isnan(roe) then roe end) roe, avg(case when not isnan(gross_margin) then gross_margin end) gm from fl group by 1, 2),
z0 as (select *, case when pe > 0 then -pe end npe, case when pb > 0 then -pb end npb from sn),
z as (select *, """ + ", ".join(f"({c} - avg({c}) over w) / (stddev_samp({c}) over w + 1e-12) z_{c}" for c in ("npe", "npb", "roe", "gm")) + " from z0 window w as (partition by fiscal_period))"


def _zsum(*cols: str) -> str:
    return f"case when {' or '.join(f'z_{c} is not null' for c in cols)} then {' + '.join(f'coalesce(z_{c}, 0)' for c in cols)} end"


SCORED = f"{SNAPS}, sc as (select fiscal_period, ticker, {_zsum('npb', 'npe')} as value, {_zsum('roe', 'gm')} quality, {_zsum('npb', 'npe', 'roe', 'gm')} combo from z)"


@query(f'with {SCORED} select fiscal_period, ticker, round(value, 6) as "value", round(quality, 6) quality, round(combo, 6) combo from sc')
def factor_score(spark, sf_dir):
    d = panels.factor_score(snapshots(spark, sf_dir), ["fiscal_period"])
    return d.select("fiscal_period", "ticker", *(r(c, 6).alias(c) for c in ("value", "quality", "combo")))


@query(f"""with {SCORED}, k as (select *, greatest(2, cast(floor(0.2 * count(combo) over (partition by fiscal_period)) as int)) k, count(combo) over (partition by fiscal_period) n, row_number() over (partition by fiscal_period order by combo desc nulls last, ticker desc) b, row_number() over (partition by fiscal_period order by combo asc nulls last, ticker asc) w from sc)
select fiscal_period, ticker, case when b <= k then 'long' else 'short' end leg, round(case when b <= k then 1.0 / k else -1.0 / k end, 10) weight from k where n >= 6 and combo is not null and (b <= k or w <= k)""")
def factor_portfolio(spark, sf_dir):
    d = panels.factor_score(snapshots(spark, sf_dir), ["fiscal_period"])
    date = Window.partitionBy("fiscal_period")
    n = F.count("combo").over(date)
    d = d.withColumns({"n": n, "k": F.greatest(F.lit(2), F.floor(0.2 * n).cast("int")), "b": F.row_number().over(date.orderBy(F.desc_nulls_last("combo"), F.desc("ticker"))), "w": F.row_number().over(date.orderBy(F.asc_nulls_last("combo"), F.asc("ticker")))})
    d = d.where((F.col("n") >= 6) & F.col("combo").isNotNull() & ((F.col("b") <= F.col("k")) | (F.col("w") <= F.col("k"))))
    top = F.col("b") <= F.col("k")
    return d.select("fiscal_period", "ticker", F.when(top, "long").otherwise("short").alias("leg"), r(F.when(top, 1.0 / F.col("k")).otherwise(-1.0 / F.col("k")), 10).alias("weight"))


RHO = f"""{FULL}, x as (select asset, bar, {Q.ret()} ret from pnl0), y as (select *, {Q.roll('var_samp', 'ret', 21)} v from x), g as (select bar, avg(ret) ir, avg(v) av, count(ret) m, 1 as one from y group by bar),
rh as (select bar, greatest(least(({Q.roll('var_samp', 'ir', 21, 'one')} / nullif(av, 0) - 1.0 / m) / (1 - 1.0 / m), 1), 0) rho from g where m > 1), rho as (select bar, rho from rh where bar >= 20),
qs as (select quantile_cont(rho, 0.33) lo, quantile_cont(rho, 0.67) hi from rho), reg as (select bar, rho, case when rho > hi + 1e-12 then 'HIGH' when rho < lo - 1e-12 then 'LOW' else 'MID' end regime from rho, qs)"""


def correlation(spark, sf_dir):
    return structure.realized_correlation(panel(spark, sf_dir))


@query(f"with {RHO} select bar, round(rho, 8) rho, regime from reg where bar >= 20")
def corr_regime(spark, sf_dir):
    return structure.correlation_regime(correlation(spark, sf_dir).where("bar >= 20")).select("bar", r("rho").alias("rho"), "regime")


def flags(spark, sf_dir):
    reg = structure.correlation_regime(correlation(spark, sf_dir).where("bar >= 20"))
    s = reg.select("bar", (F.col("regime") == "HIGH").cast("int").alias("flag"))
    p = panel(spark, sf_dir).withColumn("ret", W.bar_return("close", KEY)).groupBy("bar").agg(F.avg("ret").alias("m")).where("bar >= 20")
    return s, p.select("bar", (F.col("m") < -0.01).cast("int").alias("flag"))


@query(f"""with {RHO}, e as (select bar, case when avg(ret) < -0.01 then 1 else 0 end e, 1 as one from x where bar >= 20 group by bar), j as (select e.bar, e, case when regime = 'HIGH' then 1 else 0 end s, one from e join reg on reg.bar = e.bar),
o as (select *, coalesce(e = 1 and {Q.prev('e', 1, 'one')} = 0, false) onset, min(case when s = 1 then bar end) over (order by bar rows between 9 preceding and current row) fst from j)
select sum(case when onset then 1 else 0 end) onsets, sum(case when onset and fst is not null then 1 else 0 end) led, round(avg(case when onset then bar - fst end), 6) mean_lead, round(avg(case when e = s then 1.0 else 0.0 end) * 100, 6) agreement_pct from o""")
def regime_lead(spark, sf_dir):
    s, e = flags(spark, sf_dir)
    return rounded(structure.regime_lead(s, e), 6)


@query(f"with {FULL}, x as (select asset, bar, {Q.ret()} ret from pnl0) select a.asset asset_a, b.asset asset_b, count(*) n, round(covar_samp(a.ret, b.ret), 10) cov, round(corr(a.ret, b.ret), 8) corr from x a join x b on a.bar = b.bar where a.bar > 0 group by 1, 2")
def covariances(spark, sf_dir):
    d = structure.covariances(panel(spark, sf_dir))
    return d.select("asset_a", "asset_b", "n", r("cov", 10).alias("cov"), r("corr").alias("corr"))


@query()
def hrp(spark, sf_dir):
    return structure.hrp_weights(panel(spark, sf_dir))


def brand_scores(spark, sf_dir):
    """Month-end scores of the panel's assets: the mean quantity ordered in the month, known at its last week."""
    from tidemark.sources.tables import table

    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    d = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("week", F.date_sub("day", F.weekday("day")))
    monthly = d.groupBy("asset", F.trunc("week", "MM").alias("month")).agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("score"))
    dates = weekly_panel(spark, sf_dir).select("week").distinct()
    bars = panels.month_ends(panel(spark, sf_dir).join(with_week(spark, sf_dir, dates), "bar"), "week")
    return monthly.join(bars, "month").select("asset", "bar", "score").join(panel(spark, sf_dir).select("asset", "bar"), ["asset", "bar"], "left_semi")


def with_week(spark, sf_dir, dates):
    """(bar, week) of build_panel's calendar."""
    w = weekly_panel(spark, sf_dir).groupBy("week").agg(F.count_distinct("asset").alias("n"))
    start = w.where("n >= 10").agg(F.min("week").alias("start"))
    return w.join(F.broadcast(start), F.col("week") >= F.col("start")).select("week", (F.row_number().over(Window.orderBy("week")) - 1).alias("bar"))


BACKTEST = f"""{FULL}, sm as (select p_brand asset, date_trunc('month', date_trunc('week', l_shipdate)) mon, cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) score from lineitem join part on l_partkey = p_partkey group by 1, 2),
me as (select date_trunc('month', wkd) mon, max(bar) bar from wk group by 1), s0 as (select asset, bar, score from sm join me using (mon) where asset in (select asset from fa)),
s1 as (select *, count(*) over (partition by bar) n, row_number() over (partition by bar order by score desc, asset desc) b, row_number() over (partition by bar order by score, asset) w from s0), s2 as (select *, greatest(2, cast(floor(0.2 * n) as int)) k from s1 where n >= 6),
j as (select p.asset, p.bar, {Q.ret('p.asset', 'p.close').replace('order by bar', 'order by p.bar')} ret, case when d.bar is not null then coalesce(case when b <= k then 1.0 / k when w <= k then -1.0 / k else 0 end, 0) end x from pnl0 p left join s2 on p.asset = s2.asset and p.bar = s2.bar left join (select distinct bar from s2) d on d.bar = p.bar),
h as (select asset, bar, ret, coalesce({Q.held('x')}, 0) weight from j), g as (select bar, coalesce({Q.prev('weight')}, 0) * ret - abs(weight - coalesce({Q.prev('weight')}, 0)) * 0.0003 leg from h)"""


@query(f"with {BACKTEST} select bar, round(sum(leg), 10) net from g group by bar")
def factor_backtest(spark, sf_dir):
    return rounded(pnl.portfolio_returns(panels.factor_backtest(panel(spark, sf_dir), brand_scores(spark, sf_dir)), KEY), 10)


@query(f"""with {BACKTEST}, rn as (select bar, sum(leg) net from g group by bar), hl as (select asset, bar, ret, coalesce({Q.prev('weight')}, 0) held, abs(weight - coalesce({Q.prev('weight')}, 0)) * 0.0003 cost from h),
{shuffled_sql('hl', 'held, cost,')}, pn as (select perm_id, bar, sum(held * ret - cost) net from sh group by 1, 2), {p_sql('rn', 'pn')}""")
def factor_permutation(spark, sf_dir):
    return rounded(panels.fixed_weight_permutation(panels.factor_backtest(panel(spark, sf_dir), brand_scores(spark, sf_dir)), PANEL_PERM), 6)


@query()
def panic_battery(spark, sf_dir):
    return battery.panic_battery(hmm_labels(spark, sf_dir), KEY, 2, n_perm=REGIME_PERM)


def calm_summary(d: DataFrame) -> DataFrame:
    d = regimes.overnight_in_calm(d, KEY, 2)
    return d.groupBy("asset").agg(F.sum(F.col("calm").cast("int")).alias("calm_bars"), r(M.total_return_pct("net"), 4).alias("ret_pct"), r(M.sharpe("net"), 6).alias("sharpe"))


@query()
def overnight_calm(spark, sf_dir):
    """The overnight return on calm bars, by the regimes of a fitted model."""
    d = daily_bars(spark, sf_dir).withColumn("ret", W.bar_return("close", KEY))
    return calm_summary(d.join(regimes.label(d, regimes.fit_models(d.where("bar > 0"), KEY, k=3), KEY).select("asset", "bar", "regime"), ["asset", "bar"]))


@query(f"""with {SIZED}, v as (select asset, bar, regime, {Q.roll('stddev_samp', 'ret', 20)} sd from lab), ov as (select asset, bar, coalesce(open / {Q.prev('close')} - 1, 0) nt from bars),
c as (select *, coalesce(regime <> 2 and sd <= median(sd) over (partition by asset), false) calm from v join ov using (asset, bar)), f as (select asset, calm, case when calm then nt - 1e-4 else 0 end net from c)
select asset, sum(case when calm then 1 else 0 end) calm_bars, round({Q.total()}, 4) ret_pct, round({Q.sharpe()}, 6) sharpe from f group by asset""")
def overnight_calm_sized(spark, sf_dir):
    """The same by regimes that SQL can reproduce."""
    d = daily_bars(spark, sf_dir).withColumn("ret", W.bar_return("close", KEY))
    return calm_summary(d.join(sized(d).select("asset", "bar", "regime"), ["asset", "bar"]))


def hmm_labels(spark, sf_dir):
    ret = returns(spark, sf_dir)
    return cut(regimes.label(ret, regimes.fit_models(ret.where("bar > 0"), KEY, k=3, train=0.4), KEY))


@query()
def direction_by_hmm_regime(spark, sf_dir):
    return rounded(regimes.direction_by_regime(hmm_labels(spark, sf_dir), KEY))


@query()
def hmm_crisis_fade(spark, sf_dir):
    """Fading crisis bars by the fitted model's causal labels, with the gate over the folds that had any."""
    d = pnl.prelagged_returns(regimes.crisis_fade(hmm_labels(spark, sf_dir), KEY, 2), KEY, "ret")
    out = d.groupBy("asset").agg(r(M.total_return_pct("net"), 4).alias("ret_pct"), r(M.profit_factor("net"), 6).alias("pf"), F.sum((F.col("position") != 0).cast("int")).alias("active"))
    return out.join(battery.stream_gate(d.select("asset", "bar", "net"), KEY, active_only=True), "asset")


@query(f"""with {SIZED}, p as (select asset, bar, ret, case when {Q.prev('regime')} = 2 then -sign({Q.prev('ret')}) else 0 end as position from lab), f as (select asset, bar, position * ret - abs(position - coalesce({Q.prev('position')}, 0)) * 0.0003 net, count(*) over (partition by asset) n from p),
o as (select asset, least(bar // (n // 6), 5) fold, {Q.total()} r, max(case when net <> 0 then 1 else 0 end) act from f group by 1, 2), g as (select asset, cast(coalesce(sum(case when r > 0 then 1 else 0 end) filter (act = 1), 0) as bigint) profitable, count(*) filter (act = 1) folds from o group by 1)
select asset, profitable, folds, case when folds = 0 then 'N/A' when profitable >= 0.5 * folds - 1e-12 then 'PASS' else 'FAIL' end verdict from g""")
def crisis_fade_gate(spark, sf_dir):
    d = pnl.prelagged_returns(regimes.crisis_fade(sized(returns(spark, sf_dir)), KEY, 2), KEY, "ret")
    return battery.stream_gate(d.select("asset", "bar", "net"), KEY, active_only=True)


@query(f"""with {FULL}, {_xs_cte('momentum')}, nn as (select *, count(*) over () n from xs), o as (select least(bar // (n // 6), 5) fold, {Q.total()} r from nn group by 1)
select 'momentum' as name, cast(sum(case when r > 0 then 1 else 0 end) as bigint) profitable, count(*) folds, case when sum(case when r > 0 then 1 else 0 end) >= 0.6 * count(*) - 1e-12 then 'PASS' else 'FAIL' end verdict from o""")
def xs_gate(spark, sf_dir):
    net = panels.xs_portfolio(panel(spark, sf_dir), k=5, **SCORES["momentum"][1])
    return battery.stream_gate(net.withColumn("name", F.lit("momentum")), ["name"])


@query(f"""{MURPHY}, s as (select avg((prob - outcome) * (prob - outcome)) brier, var_pop(outcome) brier_base from f) select n, round(1 - brier / brier_base, 8) skill, round(resolution, 8) resolution, coalesce(1 - brier / brier_base > 0.01 and resolution > 0.001, false) survives from m, s""")
def forecast_verdict(spark, sf_dir):
    d = calibration.useful(calibration.calibration_report(forecasts(spark, sf_dir)))
    return d.select("n", r("skill").alias("skill"), r("resolution").alias("resolution"), "survives")


@query(f"""with o as (select asset, max(case when overlay = 'target' then sharpe end) > max(case when overlay = 'hold' then sharpe end) higher_sharpe, max(case when overlay = 'target' then vol_cv end) < max(case when overlay = 'hold' then vol_cv end) steadier,
max(case when overlay = 'target' then max_drawdown end) > max(case when overlay = 'hold' then max_drawdown end) shallower from ({SQL['vol_target_report']}) group by asset) select *, higher_sharpe and steadier and shallower survives from o""")
def overlay_verdict(spark, sf_dir):
    return volatility.overlay_wins(vol_target_report(spark, sf_dir), KEY)


@query(f"""with {BARS}, pr as (select asset, bar, close, {Q.ret()} ret from bars), pj as (select a.asset asset_a, b.asset asset_b, a.bar, ln(a.close) - ln(b.close) x from pr a join pr b on a.bar = b.bar and a.asset < b.asset)
select asset_a, asset_b, count(*) n, round(avg(close), 6) mean_close, round(min(close), 6) low, round(max(close), 6) high from (select *, 100 * exp(x - avg(x) over (partition by asset_a, asset_b)) as close from pj) group by 1, 2""")
def spread_prices(spark, sf_dir):
    d = panels.spread_prices(panels.pair_frames(bars_once(spark, sf_dir).select("asset", "bar", "close")))
    return d.groupBy("asset_a", "asset_b").agg(F.count(F.lit(1)).alias("n"), *(r(f("close"), 6).alias(n) for f, n in ((F.avg, "mean_close"), (F.min, "low"), (F.max, "high"))))


@query(f"with {BARS}, r as (select asset, bar, {Q.ret()} x from bars), m as (select *, avg(x) over (partition by asset) mu, lead(x) over (partition by asset order by bar) nx from r) select asset, round(case when sum((x - mu) * (x - mu)) <= 1e-12 then 0 else sum((x - mu) * (nx - mu)) / sum((x - mu) * (x - mu)) end, 8) autocorr from m group by asset")
def lag1_autocorr(spark, sf_dir):
    d = returns(spark, sf_dir).withColumns({"mu": F.avg("ret").over(Window.partitionBy("asset")), "nx": W.lag("ret", KEY, -1)})
    return rounded(d.groupBy("asset").agg(M.lag1_autocorr("ret", "mu", "nx").alias("autocorr")))
