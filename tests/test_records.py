"""Record operators against brute force, with nulls, ties, repeats, empty tables and a hot key."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.prefix import exact_median, running
from tidemark.operators import asof, fill, history, regrid, spikes, trailing
from tidemark.operators.bars_data import current_bars
from tidemark.operators.filings import distinct_filings

NAN = float("nan")
FUND = "filing_id bigint, date_filed date, ticker string, sector string, fiscal_period string, pe double, pb double, roe double, market_cap double, loaded_at timestamp_ntz, value string"
D = dt.date


def ts(*a):
    return dt.datetime(*a)


def filing(i, day, ticker="T", sector="Tidal Power", period="2010Q1", pe=10.0, pb=1.0, roe=0.1, cap=1e9, at=ts(2010, 1, 1)):
    return (i, day, ticker, sector, period, pe, pb, roe, cap, at, "clash")


def test_running_equals_plain_windows(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 50}", i // 40, i, rng.choice([None, 1.0, 2.5, -4.0])) for i in range(4000)]
    rng.shuffle(rows)
    d = spark.createDataFrame([*rows, (None, 1, 1, 1.0), ("hot", None, 9, 1.0)], "g string, b int, o int, v double")
    got = running(d, ["g"], "b", ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "p": ("prev", F.col("v"))}).toPandas().sort_values("o").reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["g", "b", "o", "v"]).sort_values("o").reset_index(drop=True)
    by = want.groupby("g").v
    for col, w in (("s", by.transform(lambda x: x.fillna(0).cumsum())), ("m", by.transform(lambda x: x.cummax().ffill())), ("l", by.transform(lambda x: x.ffill())), ("p", by.transform(lambda x: x.ffill().shift()))):
        assert np.allclose(got[col].astype(float), w.astype(float), equal_nan=True), col


def test_exact_median(spark):
    rng = np.random.default_rng(1)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)) for v in np.round(rng.normal(0, 3, n), 1).tolist()] + [("e", None), ("f", 0.0), ("f", 0.0), ("a", None)]
    got = {r.g: r.median for r in exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = pd.DataFrame(rows, columns=["g", "v"]).dropna().groupby("g").v.median()
    assert got == pytest.approx(want.to_dict())


def test_distinct_filings(spark):
    rows = [filing(1, D(2010, 1, 2), " t ", at=ts(2010, 1, 5)), filing(1, D(2010, 1, 2), "T", at=ts(2010, 1, 3)), filing(None, D(2010, 1, 2)), filing(2, None, None), filing(3, None, "u", at=None)]
    got = sorted((r.filing_id, r.ticker, r.loaded_at, r.roe) for r in distinct_filings(spark.createDataFrame(rows, FUND), ["roe"]).collect())
    assert got == [(1, "T", ts(2010, 1, 3), 0.1), (3, "U", None, 0.1)]


def test_fill_levels_flags_and_modes(spark):
    sectors = spark.createDataFrame([(1, "Tidal Power"), (2, "Deep Mining"), (3, None)], "sector_id int, sector_name string")
    rows = [
        filing(1, D(2010, 2, 1), pe=10.0), filing(2, D(2010, 2, 3), pe=20.0), filing(3, D(2010, 2, 5), pe=30.0, sector=" deep MINING"), filing(4, None, pe=NAN, sector="N/A", cap=0.0),
        filing(4, None, "t ", pe=NAN, sector="N/A", cap=0.0, at=ts(2011, 1, 1)), filing(5, D(2099, 1, 1), "alone", pe=600.0, sector=None, cap=None), filing(6, D(2011, 1, 1), "pe0", pe=0.0, cap=float("inf")),
    ]
    got = {(r.filing_id, r.field): (r.filled, r.level, r.support) for r in fill.fill_filings(spark.createDataFrame(rows, FUND), sectors).collect()}
    assert got[4, "pe"] == ("20.0", "ticker_period", 3)
    assert got[4, "sector"] == ("Tidal Power", "ticker_period", 3)
    assert got[4, "date_filed"] == ("2010-02-03", "ticker_period", 3)
    assert got[4, "market_cap"] == ("1.0E9", "ticker_period", 3)
    assert got[5, "pe"][1] == "period" and got[5, "market_cap"][1] == "period" and got[5, "sector"][1] == "period"
    assert (6, "date_filed") not in got and {k[0] for k in got} == {4, 5, 6}
    assert fill.fill_filings(spark.createDataFrame([], FUND), sectors).count() == 0


def test_fill_without_any_support(spark):
    d = spark.createDataFrame([(1, "a", None, None), (2, None, None, "x")], "id bigint, g string, v double, c string")
    got = {(r.id, r.field): (r.filled, r.level) for r in fill.fill_missing(d, "id", ["v"], ["c"], [fill.Level("g", ("g",), 1), fill.Level("all", (), 1)]).collect()}
    assert got == {(1, "v"): (None, None), (2, "v"): (None, None), (1, "c"): ("x", "all")}


def test_known_at_by_brute_force(spark):
    rng = random.Random(5)
    day = lambda: D(2010, 1, 1) + dt.timedelta(days=rng.randrange(60))
    at = lambda: ts(2010, 1, 1) + dt.timedelta(hours=rng.randrange(60 * 24))
    f = [filing(i, rng.choice([day(), day(), None]), rng.choice(["hot", "HOT ", "b", "c"]), pb=rng.choice([1.0, 2.0, NAN, None]), at=at()) for i in range(400)]
    f += [(*x[:9], x[9] + dt.timedelta(days=1), x[10]) for x in f[::7]] + [filing(9001, D(2010, 1, 5), None), filing(None, D(2010, 1, 5))]
    e = [(i, at(), rng.choice(["hot", " Hot", "b", "none"]), "clash") for i in range(300)]
    e += e[::5] + [(None, ts(2010, 1, 1), "hot", ""), (9001, None, "hot", ""), (9002, ts(2010, 1, 1), None, "")] + [(9003, f[0][9], f[0][2], "")]
    first = {}
    for x in f:
        if x[0] is not None and x[2] is not None:
            first[x[0]] = min(first.get(x[0], x), x, key=lambda y: y[9])
    want = {}
    for i, when, t, _ in e:
        if None in (i, when, t):
            continue
        ok = [(x[1], x[9], x[0]) for x in first.values() if x[2].strip().upper() == t.strip().upper() and x[1] and x[6] is not None and x[6] == x[6] and x[1] <= when.date() and x[9] <= when]
        if ok:
            want[i] = max(ok)[2]
    events = spark.createDataFrame(e, "rebal_id bigint, rebal_ts timestamp_ntz, ticker string, pb string")
    got = {r.rebal_id: r.known_filing_id for r in asof.rebalances_with_pb(spark.createDataFrame(f, FUND), events).collect()}
    assert got == want and len(want) > 100
    assert asof.rebalances_with_pb(spark.createDataFrame([], FUND), events).count() == 0
    assert asof.rebalances_with_pb(spark.createDataFrame(f, FUND), events.limit(0)).count() == 0


def test_spike_rule_refuses_what_the_filter_overlooks():
    assert spikes.SpikeRule().settling <= 8
    for bad in (dict(stuck=5), dict(moves=3.0), dict(vanish=0.001), dict(width=5)):
        with pytest.raises(ValueError):
            spikes.SpikeRule(**bad)
    rule, m = spikes.SpikeRule(), 0.01
    rng = np.random.default_rng(2)
    for _ in range(2000):  # the latest reading at which a run's variance vanishes, after any history
        before = np.cumsum(rng.normal(0, m * rng.choice([0.2, 1, 5, 30]), 40))
        x = np.concatenate([before, np.full(rule.stuck, before[-1] + m * rng.normal(0, rng.choice([0.1, 3, 12, 40])))])
        assert spikes.kalman_flags(x, m, rule)[1][-rule.stuck :].any()


def test_runs_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(e, s, rng.choice([None, 1.0, 1.0, 2.0])) for e in ("a", "b", "c") for s in sorted(rng.sample(range(5000), 900))] + [("d", s, 7.0) for s in range(0, 32000, 3)] + [("e", 5, None), (None, 1, 1.0), ("f", None, 1.0)]
    got = sorted((r.e, r.first_slot, r.last_slot, r.next_slot, str(r.v)) for r in history.coalesce_runs(spark.createDataFrame(rows, "e string, s int, v double"), "e", "s", "v", 15).collect())
    want = []
    for e in "abcde":
        mine = [(s, v) for k, s, v in rows if k == e]
        for i, (s, v) in enumerate(mine):
            if i and mine[i - 1][1] == v:
                want[-1][2] = s
            else:
                if i:
                    want[-1][3] = s
                want.append([e, s, s, None, str(v)])
    assert got == sorted(map(tuple, want), key=lambda x: x[:2])


def brute_runs(rows):
    out = []
    for e in sorted({k for k, s, _ in rows if k is not None and s is not None}):
        mine = sorted((s, v) for k, s, v in rows if k == e)
        for i, (s, v) in enumerate(mine):
            if i and mine[i - 1][1] == v:
                out[-1][2] = s
            else:
                if i:
                    out[-1][3] = s
                out.append([e, s, s, None, v])
    return sorted(map(tuple, out))


def test_runs_over_any_slots(spark):
    rng = random.Random(4)
    wide = sorted(rng.sample(range(-(2**44), 2**44), 3000))
    near = sorted(rng.sample(range(-4000, 4000), 2500))
    rows = [("a", s, rng.choice("xxxy")) for s in wide] + [("b", s, rng.choice("xxxy")) for s in near] + [("c", s, "x") for s in range(65534, 65538)] + [("d", s, "x") for s in wide[::7]]
    d = spark.createDataFrame(rows, "e string, s bigint, v string")
    run = lambda d, **o: sorted((r.e, r.first_slot, r.last_slot, r.next_slot, r.v) for r in history.coalesce_runs(d, "e", "s", "v", **o).collect())
    assert run(d) == brute_runs(rows)
    assert run(d.where("e = 'c'"), slot_bits=20) == [("c", 65534, 65537, None, "x")]
    for bad in (d.where("e = 'c'"), d.where("e = 'b'")):
        with pytest.raises(Exception, match="slots must lie in"):
            run(bad, slot_bits=16)
    assert run(d.limit(0)) == []


def test_roe_history(spark):
    d = lambda n: D(2010, 1, n)
    rows = [
        filing(1, d(1), roe=0.1), filing(2, d(2), roe=0.10000004), filing(3, d(3), roe=NAN), filing(4, d(5), roe=0.3, at=ts(2010, 2, 1)), filing(5, d(5), roe=0.2, at=ts(2010, 2, 2)),
        filing(6, None, roe=0.9), filing(7, D(1900, 1, 1), roe=0.9), filing(8, d(7), " t", roe=0.2), filing(8, d(7), "T", roe=0.2, at=ts(2011, 1, 1)), filing(9, d(9), "U", roe=None),
    ]
    got = sorted((r.ticker, r.valid_from, r.valid_to, r.roe) for r in history.roe_history(spark.createDataFrame(rows, FUND)).collect())
    assert got == [("T", "2010-01-01", "2010-01-03", 0.1), ("T", "2010-01-05", "9999-12-31", 0.2)]
    assert history.roe_history(spark.createDataFrame([], FUND)).count() == 0


BAR = "asset string, bar int, bar_ts timestamp_ntz, open double, high double, low double, close double, volume bigint, loaded_at timestamp_ntz, source string"


def bar(asset, n, close, day=None, op=5.0, at=ts(2020, 1, 1)):
    when = None if day is None else dt.datetime.combine(day, dt.time(21))
    return (asset, n, when, op, 1.0, 1.0, close, 1, at, "clash")


def test_current_bars(spark):
    rows = [bar("a", 0, 1.0), bar("a", 0, 2.0, at=ts(2020, 1, 2)), bar("a", 0, 2.0, at=ts(2020, 1, 2)), bar("a", 1, 3.0, at=None), bar(None, 0, 1.0), bar("a", None, 1.0)]
    assert sorted((r.bar, r.close) for r in current_bars(spark.createDataFrame(rows, BAR), ["close"]).collect()) == [(0, 2.0), (1, 3.0)]


def brute_cases(v, rule=spikes.SpikeRule()):
    """The rule, read literally, over the readings of one series (pos, value)."""
    out = {(p, "impossible") for p, x in v if x <= 0}
    pos = [(p, np.log(x)) for p, x in v if x > 0]
    if len(pos) > 1:
        far = rule.moves * np.median(np.abs(np.diff([x for _, x in pos])))
        for w in (1, 2, 3):
            for s in range(1, len(pos) - w):
                if all(abs(pos[i][1] - pos[s - 1][1]) >= far and abs(pos[i][1] - pos[s + w][1]) >= far for i in range(s, s + w)):
                    out |= {(pos[i][0], "spike") for i in range(s, s + w)}
    same = [i > 0 and v[i][1] == v[i - 1][1] for i in range(len(v))]
    if sum(same) * 5 < len(v):
        start = 0
        for i in range(1, len(v) + 1):
            if i == len(v) or not same[i]:
                if i - start >= 8:
                    out |= {(v[j][0], "stuck") for j in range(start, i)}
                start = i
    return out


def test_implausible_by_brute_force(spark):
    rng, rows, want = random.Random(4), [], set()
    for a in range(30):
        x, v, wild = 100.0, [], rng.choice([0.0005, 0.01, 0.05])
        for i in range(rng.choice([1, 2, 9, 60, 400])):
            x *= math.exp(rng.gauss(0, wild))
            if rng.random() < 0.01:
                x *= 3
            v.append(round(float(x), 2))
        i = 0
        while i < len(v):
            kind = rng.random()
            if kind < 0.02:
                for j in range(i, min(i + rng.choice([1, 2, 3, 4]), len(v))):
                    v[j] = round(float(v[j]) * rng.choice([10, 0.1, 1.3]), 2)
            elif kind < 0.03:
                v[i] = rng.choice([0.0, -1.0])
            elif kind < 0.035:
                v[i : i + 9] = [v[i]] * len(v[i : i + 9])
            elif kind < 0.05:
                v[i] = rng.choice([NAN, None])
            i += 1
        rows += [(f"s{a}", "f", i, x) for i, x in enumerate(v)]
        want |= {(f"s{a}", p, k) for p, k in brute_cases([(i, x) for i, x in enumerate(v) if x is not None and x == x])}
    d = spark.createDataFrame(rows, "source string, field string, pos bigint, v double")
    for block in (16, 4096):  # small blocks: cuts within spikes and stuck runs
        got = {(r.source, r.pos, r.kind) for r in spikes.find_implausible(d, block=block).collect()}
        assert {x for x in got ^ want if x[2] != "stuck" or (x[0], x[1], "impossible") not in want} == set()
    assert {k for _, _, k in want} == {"impossible", "spike", "stuck"}
    assert spikes.find_implausible(d.limit(0)).count() == 0


def test_spike_rule_refuses_blind_filters():
    with pytest.raises(ValueError):
        spikes.SpikeRule(threshold=8.0)


def test_onto_grid_fills_marks_and_bounds(spark):
    d = spark.createDataFrame([("a", 10, 1.0), ("a", 13, 4.0), ("a", 20, 5.0), ("b", 12, 7.0), ("c", 5, None), (None, 5, 1.0)], "source string, slot bigint, value double")
    got = {(r.source, r.slot): (r.value, r.status) for r in regrid.onto_grid(d, max_fill=3, start=9, end=21).collect()}
    assert got["a", 9] == (None, "before") and got["a", 21] == (None, "after") and got["a", 12] == (3.0, "interpolated") and got["a", 17] == (None, "missing") and got["a", 13] == (4.0, "observed")
    assert [k for k in sorted(got) if k[0] == "b"] == [("b", s) for s in range(9, 22)] and len(got) == 26
    assert regrid.onto_grid(d.limit(0)).count() == 0


def test_weekday_grid(spark):
    days = {0: D(2021, 1, 1), 1: D(2021, 1, 2), 2: D(2021, 1, 5), 3: D(2021, 1, 7), 4: D(2021, 1, 8)}  # Fri, Sat, Tue, Thu, Fri
    rows = [bar("a", n, 1.0 + n, day) for n, day in days.items()] + [bar("a", 5, 0.0, D(2021, 1, 11)), bar("a", 6, NAN, D(2021, 1, 12)), bar("a", 7, 1.0, None)]
    got = {regrid.__name__ and str(D(1970, 1, 1) + dt.timedelta(days=r.slot)): r.status for r in regrid.weekday_closes(spark.createDataFrame(rows, BAR)).collect()}
    assert got == {"2021-01-01": "observed", "2021-01-04": "interpolated", "2021-01-05": "observed", "2021-01-06": "interpolated", "2021-01-07": "observed", "2021-01-08": "observed"}


def test_trailing_totals_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(s, d, rng.randrange(1, 900), rng.randrange(1, 3)) for s in ("a", "b") for d in sorted(rng.sample(range(200), 60))] + [("c", 7, 5, 1)]
    got = {(r.source, r.day): (r.age, r.total_7, r.count_7, r.total_30, r.count_30) for r in trailing.trailing_totals(spark.createDataFrame([*rows, (None, 1, 1, 1)], "source string, day int, total bigint, count bigint")).collect()}
    want = {}
    for s in "abc":
        mine = {d: (t, c) for k, d, t, c in rows if k == s}
        for d in range(min(mine), max(mine) + 1):
            part = lambda n, j: sum(x[j] for k, x in mine.items() if d - n < k <= d)  # noqa: E731, B023
            want[s, d] = (d - min(mine) + 1, part(7, 0), part(7, 1), part(30, 0), part(30, 1))
    assert got == want
    assert trailing.trailing_closes(spark.createDataFrame([], BAR)).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found"])
def test_queries_equal_their_sql(spark, tiny, name):
    import os

    import duckdb

    from tidemark.plans.records import QUERIES, SQL

    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tiny}/{f}'")
    got = QUERIES[name](spark, tiny)
    want = c.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
