"""Windows, metrics, strategies and the battery: known answers, properties, and the comparison SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import windows as W
from tidemark.operators import battery, calibration, features, ledger, logistic, pnl, regimes, scenarios, strategies, structure, volatility
from tidemark.plans import market, risk

KEY = ["asset"]
BARS = "asset string, bar int, open double, high double, low double, close double"


def frame(spark, closes, asset="A", opens=None):
    c = np.asarray(closes, float)
    o = np.r_[c[:1], c[:-1]] if opens is None else np.asarray(opens, float)
    rows = [(asset, i, float(o[i]), float(max(o[i], c[i])), float(min(o[i], c[i])), float(c[i])) for i in range(len(c))]
    return spark.createDataFrame(rows, BARS)


def path(n, seed, mu=0.0, sd=0.01, phi=0.0):
    rng, r = np.random.default_rng(seed), np.zeros(n)
    for i in range(1, n):
        r[i] = mu + phi * r[i - 1] + rng.normal(0, sd)
    return 100 * np.exp(np.cumsum(r))


def column(df, name):
    return [x[name] for x in df.orderBy("bar").collect()]


def test_windows_against_pandas(spark):
    c = path(900, 1)
    s = pd.Series(c)
    d = frame(spark, c)
    d = W.ewm_mean(W.ewm_mean(d, KEY, "close", 12, "e12"), KEY, "close", 26, "a26", adjust=True)
    d = d.select("bar", "e12", "a26", W.roll_mean("close", 20, KEY).alias("m"), W.roll_std("close", 20, KEY).alias("s"), W.roll_max("close", 50, KEY).alias("x"), W.change("close", KEY, 5).alias("p"))
    got = d.toPandas().sort_values("bar").set_index("bar")
    want = {"e12": s.ewm(span=12, adjust=False).mean(), "a26": s.ewm(span=26).mean(), "m": s.rolling(20).mean(), "s": s.rolling(20).std(), "x": s.rolling(50).max(), "p": s.pct_change(5)}
    for k, w in want.items():
        assert np.allclose(got[k], w, rtol=1e-10, atol=1e-12, equal_nan=True), k


def test_costs_and_timing(spark):
    d = frame(spark, [100, 100, 100, 100]).withColumn("position", F.element_at(F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0))), F.col("bar") + 1))
    assert column(pnl.strategy_returns(d, KEY), "net") == pytest.approx([0, -3e-4, 0, -3e-4])
    for at, gain in ((2, 0.0), (1, 0.1)):
        d = frame(spark, [100, 100, 110, 110, 110]).withColumn("position", F.when(F.col("bar") >= at, 1.0).otherwise(0.0))
        assert sum(column(pnl.strategy_returns(d, KEY, pnl.Costs(0, 0)), "net")) == pytest.approx(gain)


def test_metrics(spark):
    one = lambda v, e: spark.createDataFrame([(float(x),) for x in v] or [], "net double").agg(e.alias("v")).first().v
    assert one([0, 1, -1, 1, -1, 1], M.profit_factor("net")) == pytest.approx(1.5)
    assert one([0.1, 0.2], M.profit_factor("net")) == float("inf") and one([], M.profit_factor("net")) == 1.0 and one([0], M.profit_factor("net")) == 1.0
    assert one([0.1, -0.1], M.total_return_pct("net")) == pytest.approx(-1.0) and one([], M.total_return_pct("net")) == 0
    assert one([0.1, float("nan"), float("inf")], M.mean_bps("net")) == pytest.approx(1000)
    assert one([0.01, 0.01], M.sharpe("net")) == 0
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(M.safe_corr("x", "y").alias("v")).first().v is None


def test_permuted_prices_keep_ends_and_drop_autocorrelation(spark):
    c = path(1500, 5, phi=-0.4)
    d = frame(spark, c)
    p = scenarios.permute_prices(d, KEY, 20).toPandas().sort_values(["perm_id", "bar"])
    ac = lambda x: np.corrcoef(x[:-1], x[1:])[0, 1]
    r = np.diff(np.log(c))
    made = [np.diff(np.log(g.close.to_numpy())) for _, g in p.groupby("perm_id")]
    assert all(len(m) == len(r) for m in made) and abs(np.mean([ac(m) for m in made])) < 0.05 and ac(r) < -0.3
    for _, g in p.groupby("perm_id"):
        assert g.close.iloc[0] == pytest.approx(c[0]) and g.close.iloc[-1] == pytest.approx(c[-1])
    assert np.std(made[0]) == pytest.approx(np.std(r), rel=0.05)
    head = scenarios.permute_prices(d, KEY, 2, start=100).where("bar <= 100 and perm_id = 2").orderBy("bar").toPandas()
    assert np.allclose(head.close, c[:101])
    assert scenarios.permute_prices(frame(spark, [1.0, 2.0]), KEY, 3).count() == 6


def test_mcpt_calls_noise_noise(spark):
    for rule, c in ((strategies.always_long, path(800, 3, 0.001)), (strategies.arbitrary, path(800, 5)), (strategies.after_down, path(800, 7))):
        assert battery.mcpt(frame(spark, c), KEY, rule, n_perm=60).first().p_value >= 0.05


def test_lookahead_audit(spark):
    d = frame(spark, path(500, 1, 0.0003, 0.011))
    assert battery.lookahead_audit(d, KEY, strategies.sma20).first().clean
    for leak in (strategies.peek, strategies.centred):
        out = battery.lookahead_audit(d, KEY, leak).first()
        assert not out.clean and out.mismatches > 0 and out.cuts == 12


def test_walk_forward_gate_and_beta(spark):
    trend, lucky = path(2400, 2, 0.0007, 0.009), path(2400, 4, -0.0002, 0.008)
    lucky[1200:1600] *= np.exp(0.004 * np.arange(400))
    lucky[1600:] *= np.exp(0.004 * 400)
    assert battery.gate(battery.walk_forward(frame(spark, trend), KEY, strategies.always_long), KEY).first().passed
    assert not battery.gate(battery.walk_forward(frame(spark, lucky), KEY, strategies.trend), KEY).first().passed
    rows = battery.regime_check(frame(spark, trend), KEY, strategies.always_long).collect()
    assert sorted(x.regime for x in rows) == ["DOWN", "FLAT", "UP"] and sum(x.n for x in rows) == 2400
    for bars, folds in ((59, 1), (20, 0), (3, 0), (120, 6)):  # of 59 bars the last fold takes 14, the others have 9 each
        assert battery.walk_forward(frame(spark, [1.0] * bars), KEY, strategies.trend).count() == folds


def test_latch_prefers_enter(spark):
    d = spark.createDataFrame([("A", i, *x) for i, x in enumerate([(0, 0), (1, 1), (0, 0), (0, 1), (1, 0)])], "asset string, bar int, e int, l int")
    assert column(d.withColumn("p", W.latch(F.col("e") == 1, F.col("l") == 1, KEY)), "p") == [0, 1, 1, 0, 1]


def test_ledger_round_trip(spark, tmp_path):
    p = str(tmp_path / "ledger")
    assert ledger.load_trials(spark, p).count() == 0
    t = spark.createDataFrame([("a", 0.001, 1.0), ("b", 0.009, 2.0), ("c", 0.5, 3.0)], "name string, p_value double, total_return double")
    ledger.log_trials(t, p, "r1")
    ledger.log_trials(t.withColumn("extra", F.create_map(F.lit("k"), F.lit("v"))), p, "r2")
    assert ledger.load_trials(spark, p).count() == 6 and ledger.load_trials(spark, p, "r2").first().extra == {"k": "v"}
    out = ledger.assess(ledger.load_trials(spark, p, "r1")).first()
    assert (out.n_trials, out.naive_passes, out.corrected_passes, out.survivors) == (3, 2, 2, "a,b")
    assert ledger.assess(t.limit(0)).first().n_trials == 0


def test_calibration_edges_and_properties(spark):
    rows = [(0.0, 0.0), (0.1, 1.0), (0.3, 0.0), (0.7, 1.0), (1.0, 1.0), (1.2, 1.0), (None, 1.0), (float("nan"), 0.0)]
    rel = {r.bin: r.n for r in calibration.reliability(spark.createDataFrame(rows, "prob double, outcome double")).collect()}
    assert rel == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0, 9: 1}
    rng = np.random.default_rng(0)
    p = rng.uniform(size=4000)
    o = (rng.uniform(size=4000) < p).astype(float)
    out = calibration.calibration_report(spark.createDataFrame(pd.DataFrame({"prob": p, "outcome": o}))).first()
    assert out.ece < 0.05 and out.skill > 0.2 and abs(out.recombined - out.brier) < 0.01


def test_volatility(spark):
    rng, v, r = np.random.default_rng(0), 1e-4, []
    for _ in range(3000):
        r.append(float(np.sqrt(v) * rng.normal()))
        v = 2e-6 + 0.08 * r[-1] ** 2 + 0.90 * v
    d = spark.createDataFrame([("A", i, x) for i, x in enumerate(r)], "asset string, bar int, ret double")
    f = volatility.walk_forward_vol(d, KEY, methods=("naive", "ewma", "garch"))
    one = f.where("bar = 525").toPandas().set_index("method").forecast
    x, e = np.array(r[21:525]), np.var(r[21:41])
    for y in x:
        e = 0.94 * e + 0.06 * y * y
    assert one["ewma"] == pytest.approx(e) and one["naive"] == pytest.approx(np.var(r[504:525]))
    ev = {x.method: x for x in volatility.evaluate_vol(f, KEY).collect()}
    assert ev["ewma"].gain > 0 and ev["ewma"].vol_corr > 0.2 and ev["garch"].gain > 0 and ev["naive"].gain == 0
    assert volatility.garch_variance(np.zeros(100)) == 0


def two_regimes(n=2500, seed=1):
    rng, s, states = np.random.default_rng(seed), 0, []
    for _ in range(n):
        s = s if rng.random() < 0.99 else 1 - s
        states.append(s)
    states = np.array(states)
    return states, np.where(states == 0, 0.0005, -0.001) + np.where(states == 0, 0.007, 0.025) * rng.normal(size=n)


def test_regimes_recover_states_and_filter_causally(spark):
    states, x = two_regimes()
    d = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "asset string, bar int, ret double")
    models = regimes.fit_models(d, KEY, k=2)
    m = regimes.of_row(models.toPandas().iloc[0])
    assert np.allclose(np.sqrt(m.var), [0.007, 0.025], rtol=0.25) and m.trans.diagonal().min() > 0.95
    for how in ("filter", "smooth", "viterbi"):
        assert np.mean(np.array(column(regimes.label(d, models, KEY, how=how), "regime")) == states) > 0.85
    y = x.copy()
    y[2000:] *= 5
    assert np.abs(regimes.forward(m, x)[0][:2000] - regimes.forward(m, y)[0][:2000]).max() < 1e-9
    g = regimes.smooth(m, x[:50])
    assert np.allclose(g[0].sum(axis=1), 1) and g[1].sum() == pytest.approx(49)
    assert {r.regime for r in regimes.describe(models, KEY).collect()} == {0, 1}


def test_logistic_learns_and_is_out_of_sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 2))
    y = (rng.uniform(size=900) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    d = spark.createDataFrame([("A", i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "asset string, bar int, f1 double, f2 double, target int")
    out = logistic.walk_forward_proba(d, KEY, ["f1", "f2"], train=300, step=50, least=200).toPandas().sort_values("bar")
    assert out.bar.tolist() == list(range(200, 900)) and np.corrcoef(out.prob, 1 / (1 + np.exp(-2 * x[200:, 0])))[0, 1] > 0.95
    m = logistic.Logistic().fit(x[:200], y[:200])
    assert np.allclose(out.prob[:50], m.predict_proba(x[200:250]))


def test_hrp_by_hand():
    cov = np.array([[1.0, 0.9, 0.1], [0.9, 1.0, 0.1], [0.1, 0.1, 4.0]])
    corr = cov / np.sqrt(np.outer(cov.diagonal(), cov.diagonal()))
    assert structure.leaf_order(np.sqrt((1 - corr) / 2)) == [2, 0, 1]
    w = structure.hrp(cov)
    assert w.sum() == pytest.approx(1) and w[0] == pytest.approx(w[1]) and w[2] == pytest.approx(0.95 / 4.95)
    assert structure.hrp(np.array([[2.0]])).tolist() == [1.0]


def test_target_tail(spark):
    d = frame(spark, [1.0, 2.0, 1.5])
    assert column(features.make_target(d, KEY), "target") == [1, 0, None]
    assert column(features.make_target(d, KEY, keep_tail=True), "target") == [1, 0, 0]


def test_pandas_rule(spark):
    rule = strategies.from_pandas(lambda p: (p["close"] > p["close"].shift()).astype(float), lambda d: "asset string, bar int, open double, high double, low double, close double, position double")
    assert column(rule(frame(spark, [1.0, 2.0, 1.0]), KEY), "position") == [0, 1, 0]


QUICK = ("bar_returns", "strategy_macd_200", "strategy_net_summary", "walk_forward", "lookahead_audit", "permute_prices", "ledger_assess", "murphy", "pairs_scan", "xs_momentum", "asof_factors", "factor_portfolio", "covariances", "crisis_fade")


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_their_sql(spark, tiny, name):
    both = {**market.QUERIES, **risk.QUERIES}, {**market.SQL, **risk.SQL}
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tiny}/{f}'")
    got = both[0][name](spark, tiny)
    want = c.execute(f"select {', '.join(f'"{x}"' for x in got.columns)} from ({both[1][name]})").fetchall()
    key = lambda r: tuple((x is not None, str(x) if not isinstance(x, float) else f"{x:.3g}") for x in r)
    a, b = sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or u == pytest.approx(float(v), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("rule, back, ahead", [(strategies.trend, 100, 0), (strategies.reversal, 5, 0), (strategies.gap_fade, 1, 0), (strategies.peek, 0, 1), (strategies.centred, 10, 9)])
def test_blockwise_equals_whole(spark, rule, back, ahead):
    d = frame(spark, path(1000, 8)).unionByName(frame(spark, path(301, 9), "B"))
    pick = lambda x: sorted((r.asset, r.bar, r.position) for r in x.collect())
    assert pick(W.blockwise(rule, back, 128, ahead)(d, KEY)) == pick(rule(d, KEY))
    with pytest.raises(ValueError):
        W.blockwise(rule, 200, 128)


def test_factor_backtest_holds_and_permutes(spark):
    from tidemark.operators import panels

    prices = frame(spark, path(60, 0), "a0")
    for i in range(1, 8):
        prices = prices.unionByName(frame(spark, path(60, i), f"a{i}"))
    scores = spark.createDataFrame([(f"a{i}", b, float(i)) for b in (10, 30) for i in range(8)] + [("a0", 20, 1.0)] + [("a1", 40, float("nan"))], "asset string, bar int, score double")
    w = panels.factor_backtest(prices.select("asset", "bar", "close"), scores).toPandas().pivot(index="bar", columns="asset", values="weight")
    assert (w.loc[:9] == 0).all().all() and w.loc[25, "a7"] == 0.5 and w.loc[59, "a1"] == -0.5 and (w.sum(axis=1).abs() < 1e-12).all()
    out = panels.fixed_weight_permutation(panels.factor_backtest(prices.select("asset", "bar", "close"), scores), 5).first()
    assert out.n_perm == 5 and 1 / 6 <= out.p_value <= 1


def test_registered_counts_are_the_references(spark, tiny, monkeypatch):
    from tidemark.operators import panels

    seen, made = {}, spark.createDataFrame([("A", 1.0)], "asset string, pf double")
    for module, name, at in ((battery, "mcpt", 5), (battery, "full_gauntlet", 4), (battery, "sign_flip", 2), (battery, "regime_autocorr", 2), (battery, "grid_verdicts", 4), (battery, "panic_battery", 5), (panels, "xs_permuted", 4), (panels, "fixed_weight_permutation", 1)):
        monkeypatch.setattr(module, name, lambda *a, n_perm=None, name=name, at=at, **k: (seen.update({name: n_perm or a[at]}), made)[1])
    monkeypatch.setattr("tidemark.session.cut", lambda d: d)
    for name in ("mcpt", "full_gauntlet", "sign_flip", "regime_autocorr", "grid_verdicts", "panic_battery", "xs_permuted", "factor_permutation"):
        {**market.QUERIES, **risk.QUERIES}[name](spark, tiny)
    assert seen == {"mcpt": 1000, "full_gauntlet": 1000, "sign_flip": 1000, "regime_autocorr": 2000, "grid_verdicts": 200, "panic_battery": 2000, "xs_permuted": 300, "fixed_weight_permutation": 300}


def test_sign_flip_at_the_full_count_equals_a_replay(spark, tiny):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tiny}/lineitem.parquet'")
    want = c.execute(f"select asset, pf, n_perm, p_value from ({market.SQL['sign_flip'].replace('range(1, 1001)', 'range(1, 1001)')}) order by 1").fetchall()
    got = [tuple(r) for r in market.QUERIES["sign_flip"](spark, tiny).select("asset", "pf", "n_perm", "p_value").orderBy("asset").collect()]
    assert len(got) == len(want) and all(r[2] == 1000 for r in got)
    for x, y in zip(got, want):
        assert x[1:] == pytest.approx(tuple(map(float, y[1:])), rel=1e-6)


def brands(spark, n, bars):
    rows = [(f"a{i:02}", b, float(x)) for i in range(n) for b, x in enumerate(path(bars, 100 + i))]
    return spark.createDataFrame(rows, "asset string, bar int, close double")


def test_pairs_take_all_assets(spark):
    from tidemark.operators import panels

    p = brands(spark, 15, 60)
    got = {(r.asset_a, r.asset_b) for r in panels.pairs_scan(p).collect()}
    assert len(got) == 15 * 14 // 2 and ("a13", "a14") in got
    assert {(r.asset_a, r.asset_b) for r in panels.pairs_scan(p, assets=["a02", "a14"]).collect()} == {("a02", "a14")}


def test_pairs_verdicts_by_hand(spark):
    from tidemark.operators import panels

    rng = np.random.default_rng(5)
    common, x = path(400, 3), np.zeros(400)
    for i in range(1, 400):
        x[i] = 0.5 * x[i - 1] + rng.normal(0, 0.03)  # a spread that reverts
    rows = [(a, b, float(v)) for a, s in (("A", common), ("B", common * np.exp(x)), ("C", path(400, 9))) for b, v in enumerate(s)]
    out = {(r.asset_a, r.asset_b): r for r in panels.pairs_verdicts(spark.createDataFrame(rows, "asset string, bar int, close double"), n_perm=99, least=5).collect()}
    assert len(out) == 3 and all(r.corrected_bar == pytest.approx(0.05 / 3) and round(r.p_value * 100) >= 1 for r in out.values())
    best = out["A", "B"]
    assert best.p_value == pytest.approx(0.01) and best.recent_profitable == 3 and best.candidate
    assert not any(r.candidate for r in panels.pairs_verdicts(brands(spark, 3, 60), n_perm=9, least=1).collect())


def test_pairs_pnl_has_all_pairs(spark, tiny, monkeypatch):
    monkeypatch.setattr(risk, "panel", lambda spark, sf_dir: brands(spark, 15, 40))
    got = risk.QUERIES["pairs_pnl"](spark, tiny).groupBy("asset_a", "asset_b").count().collect()
    assert len(got) == 15 * 14 // 2 and {r["count"] for r in got} == {40}


def test_gates_of_streams(spark):
    rows = [("gain", b, 0.01) for b in range(60)] + [("none", b, 0.0) for b in range(60)] + [("half", b, 0.01 if b < 10 else -0.01 if b < 20 else 0.0) for b in range(60)]
    d = spark.createDataFrame(rows, "asset string, bar int, net double")
    got = {r.asset: (r.profitable, r.folds, r.verdict) for r in battery.stream_gate(d, KEY, active_only=True).collect()}
    assert got == {"gain": (6, 6, "PASS"), "none": (0, 0, "N/A"), "half": (1, 2, "PASS")}
    got = {r.asset: r.verdict for r in battery.stream_gate(d, KEY).collect()}
    assert got == {"gain": "PASS", "none": "FAIL", "half": "FAIL"}


def test_survive_rules(spark):
    d = spark.createDataFrame([("A", "hold", 0.5, 0.3, -0.4), ("A", "target", 0.6, 0.2, -0.3), ("B", "hold", 0.5, 0.3, -0.4), ("B", "target", 0.6, 0.4, -0.3)], "asset string, overlay string, sharpe double, vol_cv double, max_drawdown double")
    assert {r.asset: r.survives for r in volatility.overlay_wins(d, KEY).collect()} == {"A": True, "B": False}
    d = spark.createDataFrame([(0.02, 0.002), (0.02, 0.0005), (None, 0.1)], "skill double, resolution double")
    assert [r.survives for r in calibration.useful(d).collect()] == [True, False, False]


def test_draws_are_permutations_without_bias(spark):
    d = spark.createDataFrame([("A", b, float(b)) for b in range(40)], "asset string, bar int, v double")
    p = scenarios.shuffle_values(d, KEY, "v", 2000).toPandas().pivot(index="perm_id", columns="bar", values="v").to_numpy()
    assert (np.sort(p, axis=1) == np.arange(40)).all() and len(np.unique(p, axis=0)) == 2000
    seen = np.zeros((40, 40))
    np.add.at(seen, (np.tile(np.arange(40), 2000), p.astype(int).ravel()), 1)
    assert ((seen - 50) ** 2 / 50).sum() < 1800  # 39 * 39 = 1521 expected
    assert abs(np.corrcoef(p[:-1].ravel(), p[1:].ravel())[0, 1]) < 0.02


def test_hrp_equals_its_definition():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 9)) @ rng.normal(size=(9, 9))
    cov = np.cov(x.T)
    got = structure.hrp(cov)

    def share(part):
        v = 1 / cov[part, part]
        return float((v / v.sum()) @ cov[np.ix_(part, part)] @ (v / v.sum()))

    def descend(part, weight):
        if len(part) == 1:
            return {part[0]: weight}
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = share(left), share(right)
        return {**descend(left, weight * b / (a + b)), **descend(right, weight * a / (a + b))}

    corr = np.corrcoef(x.T)
    order = structure.leaf_order(np.sqrt(np.clip((1 - corr) / 2, 0, 1)))
    want = descend(order, 1.0)
    assert got == pytest.approx([want[i] for i in range(9)]) and got.sum() == pytest.approx(1)


def test_grid_verdicts_ask_for_gate_and_audit(spark, tiny, monkeypatch):
    d = frame(spark, path(400, 11, phi=-0.6))
    out = {r.strategy: r for r in battery.grid_verdicts(d, {"reversal": lambda d, k: strategies.reversal(d, k, 1), "peek": strategies.peek}, KEY, n_perm=50).collect()}
    good, leak = out["reversal"], out["peek"]
    assert good.p_value == pytest.approx(1 / 51) and good.passed and good.clean and good.raw_sig and good.corrected_sig == (not good.beta)
    assert leak.passed and not leak.clean and not leak.raw_sig and not leak.corrected_sig
    seen = []
    monkeypatch.setattr(battery, "grid_verdicts", lambda bars, registry, *a, **k: seen.extend(registry))
    monkeypatch.setattr(market, "rounded", lambda d, *a: d)
    market.QUERIES["grid_verdicts"](spark, tiny)
    assert seen == list(strategies.REGISTRY) and len(seen) == 6


def test_garch_forecasts_every_due_bar(spark, tiny, monkeypatch):
    x = np.random.default_rng(2).normal(0, 0.01, 650)
    d = spark.createDataFrame([("A", b, float(v)) for b, v in enumerate(x)], "asset string, bar int, ret double")
    monkeypatch.setattr(risk, "returns", lambda spark, sf_dir: d)
    got = {r.bar: r.forecast for r in risk.QUERIES["garch"](spark, tiny).where("method = 'garch'").collect()}
    assert sorted(got) == list(range(504, 630, 21))
    for b, v in got.items():
        assert v == pytest.approx(volatility.garch_variance(x[b - 504 : b]), rel=1e-9)
    assert {r.method: r.n for r in risk.QUERIES["vol_eval_garch"](spark, tiny).collect()} == {"naive": 6, "ewma": 6, "garch": 6}


def test_long_spans_lose_no_weight(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 4)
    c = path(1000, 6)
    got = W.ewm_mean(W.ewm_mean(frame(spark, c), KEY, "close", 800, "e"), KEY, "close", 800, "a", adjust=True).toPandas().sort_values("bar")
    assert np.allclose(got.e, pd.Series(c).ewm(span=800, adjust=False).mean(), rtol=1e-10) and np.allclose(got.a, pd.Series(c).ewm(span=800).mean(), rtol=1e-10)
