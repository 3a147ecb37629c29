"""Files, paged HTTP, streams, and the contract of the entry module."""

import io
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes
from tidemark.sources import http, prices
from tidemark.streaming import filters


def test_wide_prices(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("Ticker,AA,AA,AA,AA,AA,BB,BB,BB,BB,BB\nPrice,Open,High,Low,Close,Volume,Open,High,Low,Close,Volume\nDate,,,,,,,,,,\n2020-01-02,1,2,0.5,1.5,10,5,6,4,5,1\n2020-01-03,1.5,2,1,,10,5,6,4,5.5,1\n2020-01-06,2,3,2,2.5,,5,x,4,5,1\n")
    got = [(r.asset, r.bar, str(r.bar_ts.date()), r.close) for r in prices.read_wide_prices(spark, str(p)).orderBy("asset", "bar").collect()]
    assert got == [("AA", 0, "2020-01-02", 1.5), ("AA", 1, "2020-01-06", 2.5), ("BB", 0, "2020-01-02", 5.0), ("BB", 1, "2020-01-03", 5.5)]


def test_series_closes_fundamentals_and_sinks(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Date,VIX\n2020-01-02,12.5\n2020-01-03,\nbad,1\n")
    assert [r.VIX for r in prices.read_series(spark, str(tmp_path / "v.csv"), "VIX").orderBy("bar_ts").collect()] == [12.5, None]
    (tmp_path / "c.csv").write_text("Date,X,Y\n2020-01-02,1,2\n2020-01-03,,3\n")
    assert prices.read_closes(spark, str(tmp_path / "c.csv")).count() == 3
    (tmp_path / "f.csv").write_text("date_filed,ticker,pe,pb,ps,roe,gross_margin,debt_to_equity,market_cap\n2020-01-02,X,1,,3,4,5,6,7\n")
    r = prices.read_fundamentals(spark, str(tmp_path / "f.csv"), 5).first()
    assert str(r.date_filed) == "2020-01-07" and r.pb is None and r.market_cap == 7
    prices.write_grid(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, t int, v int")
    assert sorted((x.k, x.v) for x in prices.latest(d, ["k"], "t").collect()) == [("a", 6), ("b", 7)]


def test_pages_retries_and_conversion():
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return io.BytesIO(b'{"data": [[1, "2.5"]]}')

    assert http.dig(http.get_json("u", 3, 0, opener), "data") == [[1, "2.5"]] and len(calls) == 3
    assert http.get_json("u", 2, 0, lambda *a, **k: (_ for _ in ()).throw(OSError())) is None
    assert http.dig({"a": {"b": 1}}, "a.b") == [] and http.dig(None, "x") == []


def test_json_pages_source(spark, tmp_path):
    for after, rows in (("", [[3, "0.1"], [2, "x"]]), ("2", [[1, None]]), ("1", [])):
        (tmp_path / f"BTC{after}.json").write_text(json.dumps({"data": rows}))
    spark.dataSource.register(http.JsonPages)
    d = spark.read.format("json_pages").schema("coin string, ts bigint, rate double").option("url", f"file://{tmp_path}/{{symbol}}{{after}}.json").option("symbols", "BTC").option("path", "data").option("fields", "@symbol,0,1").option("cursor", "0").option("pages", "9").load()
    assert sorted(tuple(r) for r in d.collect()) == [("BTC", 1, None), ("BTC", 2, None), ("BTC", 3, 0.1)]


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, 60).tolist()
    src = str(tmp_path / "src")
    for part in (range(0, 25), range(20, 60)):  # bars 20 to 24 come again
        spark.createDataFrame([("A", i, x[i]) for i in part], "asset string, bar bigint, ret double").coalesce(1).write.mode("append").parquet(src)
    model = regimes.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.zeros(2), np.array([2.5e-5, 4e-4]))
    for name, f in (("ewma", filters.stream_ewma), ("regime", lambda d: filters.stream_filter(d, model))):
        stream = spark.readStream.schema("asset string, bar bigint, ret double").option("maxFilesPerTrigger", 1).parquet(src)
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = spark.table("ewma").orderBy("bar").toPandas()
    v, want = None, []
    for y in x:
        want.append(v)
        v = y * y if v is None else 0.94 * v + 0.06 * y * y
    assert got.bar.tolist() == list(range(60)) and np.allclose(got.variance[1:], want[1:]) and pd.isna(got.variance[0])
    got = spark.table("regime").orderBy("bar").toPandas()
    assert np.allclose(np.stack(got.belief), regimes.forward(model, np.array(x))[0])


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("seed", [1])
def test_nothing_outside_imports_the_llm_package(seed):
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tidemark\.llm|from \.llm|import llm", p.read_text()), p


def test_checkpoint_folder_is_kept(spark):
    from tidemark.session import cut

    assert cut(spark.range(3).select(F.col("id") * 2)).count() == 3
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_assemble_filings(spark):
    ratios = spark.createDataFrame([("A", "2020-03-31", "2020-05-01", "1.5", None, "2", "x", "0.4", "1"), ("A", "2020-06-30", None, None, "3", None, "0.1", None, None)], "ticker string, fiscal_date string, filing_date string, pe string, pb string, ps string, roe string, gross_margin string, debt_to_equity string")
    metrics = spark.createDataFrame([("A", "2020-03-31", 1, "9", "8", "7", "0.5", "100"), ("A", "2020-03-31", 2, "9", "6", "7", "0.7", "200")], "ticker string, fiscal_date string, received int, pe string, pb string, ps string, roe string, market_cap string")
    a, b = prices.assemble_filings(ratios, metrics).orderBy("date_filed").collect()
    assert (str(a.date_filed), a.pe, a.pb, a.roe, a.market_cap) == ("2020-05-06", 1.5, 6.0, 0.7, 200.0)
    assert (str(b.date_filed), b.pe, b.pb, b.market_cap) == ("2020-09-18", None, 3.0, None)


def test_candles_and_funding_of_pages(spark, tmp_path):
    row = lambda t: [str(t), "1", "3", "0.5", str(t % 7), "x"]
    page = lambda n, rows, code="0": (tmp_path / n).write_text(json.dumps({"code": code, "data": rows}))
    page("A", [row(3000), row(2000)])
    page("A2000", [row(2000), row(1000)])
    page("A1000", [row(500)])
    page("A500", [row(1)])
    page("B", [row(1)], "51001")
    d = http.read_candles(spark, ["A", "B", "C"], url=f"file://{tmp_path}/{{symbol}}", more="{after}", full="2", tries="1")
    got = sorted((r.asset, r.bar_ts.timestamp(), r.close) for r in d.collect())
    assert got == [("A", 0.5, 3.0), ("A", 1.0, 6.0), ("A", 2.0, 5.0), ("A", 3.0, 4.0)]
    (tmp_path / "F").write_text(json.dumps({"code": "0", "data": [{"fundingTime": "8000", "fundingRate": "0.0001"}, {"fundingTime": "8000", "fundingRate": ""}]}))
    assert [(r.asset, r.rate) for r in http.read_funding(spark, ["F"], url=f"file://{tmp_path}/{{symbol}}").collect()] == [("F", 0.0001)]


def test_too_many_requests_wait(monkeypatch):
    import urllib.error

    slept, answers = [], [429, 500]

    def opener(url, timeout):
        if answers:
            raise urllib.error.HTTPError(url, answers.pop(0), "", None, None)
        return io.StringIO("[1]")

    monkeypatch.setattr(http.time, "sleep", slept.append)
    assert http.get_json("x", 3, 0.1, opener, 9.0) == [1] and slept == [9.0, 0.1]
