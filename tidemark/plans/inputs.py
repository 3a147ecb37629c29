"""Bars, panels, filings and forecasts derived from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources.tables import table


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, bar, day, open, high, low, close): one asset per return flag and line status; order-free aggregates."""
    d = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("x"))
    d = d.groupBy("asset", "day").agg(
        F.median("x").alias("open"), F.max("x").alias("high"), F.min("x").alias("low"), (F.sum(F.col("x").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("close")
    )
    return d.withColumn("bar", F.row_number().over(Window.partitionBy("asset").orderBy("day")) - 1)


def bars_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_bars, derived once: for plans that read the bars in several branches."""
    return cut(daily_bars(spark, sf_dir))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, bar, open, high, low, close) of event values per type and hour."""
    d = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("hour"), "ts", "value")
    d = d.groupBy("asset", "hour").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"))
    return d.withColumn("bar", F.row_number().over(Window.partitionBy("asset").orderBy("hour")) - 1)


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, week, close): weekly mean price per brand."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("x"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    d = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("week", F.date_sub("day", F.weekday("day")))
    return d.groupBy("asset", "week").agg((F.sum("x").cast("double") / F.count(F.lit(1))).alias("close"))


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date_filed, id, value): order totals as facts that become public five days after the order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.date_add(F.to_date("o_orderdate"), 5).alias("date_filed"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prob, outcome): forecasts that lie on the edges of the bins."""
    return table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 10, 6).alias("prob"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("outcome"))


BARS = """b0 as (select l_returnflag || l_linestatus asset, cast(l_shipdate as date) as day, median(l_extendedprice) as open, max(l_extendedprice) high, min(l_extendedprice) low,
 cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as close from lineitem group by 1, 2),
bars as (select *, cast(row_number() over (partition by asset order by day) - 1 as int) bar from b0)"""
HOURS = """h0 as (select event_type asset, date_trunc('hour', ts) as hr, arg_min(value, ts) as open, max(value) high, min(value) low, arg_max(value, ts) as close from events where value is not null group by 1, 2),
bars as (select *, cast(row_number() over (partition by asset order by hr) - 1 as int) bar from h0)"""
PANEL = """panel as (select p_brand asset, cast(date_trunc('week', l_shipdate) as date) wkd, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as close
 from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
FILED = "filings as (select o_orderpriority ticker, cast(cast(o_orderdate as date) + 5 as date) date_filed, o_orderkey id, o_totalprice as value from orders)"
FORECASTS = "f as (select round(l_discount * 10, 6) prob, case when l_returnflag = 'R' then 1.0 else 0.0 end outcome from lineitem)"
