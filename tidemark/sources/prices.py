"""Price and filing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FUNDAMENTALS = "date_filed date, ticker string, pe double, pb double, ps double, roe double, gross_margin double, debt_to_equity double, market_cap double"


def read_wide_prices(spark: SparkSession, path: str) -> DataFrame:
    """(asset, bar, bar_ts, open, high, low, close) of a wide CSV with two header lines (tickers, then fields) and a third
    line that names the date column. Volume is dropped, and bars of an asset that lack a field.

    Only the two header lines are read on the driver; data lines are parsed and unpivoted in one pass.
    """
    lines = spark.read.text(path)
    head = [x.value.split(",") for x in lines.limit(3).collect()]  # three header lines
    if len(head) < 2:
        raise ValueError("two header lines are needed")
    fields = {(t.strip(), f.strip().lower()): i for i, (t, f) in enumerate(zip(head[0], head[1])) if i}
    assets = sorted({t for t, _ in fields})
    cells = F.split("value", ",", -1)
    first = F.try_to_timestamp(F.element_at(cells, 1))
    one = lambda t, f: F.get(cells, F.lit(fields[t, f])).try_cast("double") if (t, f) in fields else F.lit(None).cast("double")
    bars = F.array(*(F.struct(F.lit(t).alias("asset"), *(one(t, f).alias(f) for f in ("open", "high", "low", "close"))) for t in assets))
    d = lines.select(first.alias("bar_ts"), F.explode(bars).alias("b")).where("bar_ts is not null").select("b.asset", "bar_ts", "b.open", "b.high", "b.low", "b.close")
    d = d.dropna(subset=["open", "high", "low", "close"])
    return d.withColumn("bar", F.row_number().over(Window.partitionBy("asset").orderBy("bar_ts")) - 1).select("asset", "bar", "bar_ts", "open", "high", "low", "close")


def read_series(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(bar_ts, value) of a CSV with a date column and one value column."""
    d = spark.read.option("header", True).csv(path)
    return d.select(F.try_to_timestamp(F.col(d.columns[0])).alias("bar_ts"), F.col(value).try_cast("double").alias(value)).where("bar_ts is not null")


def read_closes(spark: SparkSession, path: str) -> DataFrame:
    """(asset, bar_ts, close) of a CSV with a date column and one column per asset."""
    d = spark.read.option("header", True).csv(path)
    long = d.unpivot([d.columns[0]], d.columns[1:], "asset", "close")
    return long.select("asset", F.try_to_timestamp(F.col(d.columns[0])).alias("bar_ts"), F.col("close").try_cast("double").alias("close")).where("bar_ts is not null and close is not null")


def read_fundamentals(spark: SparkSession, path: str, lag_days: int = 0) -> DataFrame:
    """Filings of a CSV; lag_days moves date_filed to the day from which a filing may be used."""
    d = spark.read.schema(FUNDAMENTALS).option("header", True).csv(path)
    return d.withColumn("date_filed", F.date_add("date_filed", lag_days))


def write_grid(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result grid anew."""
    w = df.write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by order."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r")).select(*keys, "r.*")


def assemble_filings(ratios: DataFrame, metrics: DataFrame, lag_days: int = 5, fallback_days: int = 75) -> DataFrame:
    """Filings from two reports of the same fiscal dates, (ticker, fiscal_date, ...) each; of repeated metrics rows the last
    by `received` counts. Where a figure is missing in ratios, that of metrics is taken. A filing without date counts as
    filed fallback_days after its fiscal date; every filing may be used lag_days later.

    ratios: (ticker, fiscal_date, filing_date, pe, pb, ps, roe, gross_margin, debt_to_equity), metrics: (ticker, fiscal_date,
    received, pe, pb, ps, roe, market_cap); figures are read as numbers, what is none becomes null.
    """
    m = latest(metrics, ["ticker", "fiscal_date"], "received")
    m = m.select("ticker", "fiscal_date", *(F.col(c).alias(f"__{c}") for c in ("pe", "pb", "ps", "roe", "market_cap")))
    d = ratios.join(m, ["ticker", "fiscal_date"], "left")
    num = lambda c: F.col(c).try_cast("double")
    filed = F.coalesce(F.to_date("filing_date"), F.date_add(F.to_date("fiscal_date"), fallback_days))
    figures = [F.coalesce(num(c), num(f"__{c}")).alias(c) for c in ("pe", "pb", "ps", "roe")]
    return d.select(F.date_add(filed, lag_days).alias("date_filed"), "ticker", *figures, num("gross_margin").alias("gross_margin"), num("debt_to_equity").alias("debt_to_equity"), num("__market_cap").alias("market_cap"))
