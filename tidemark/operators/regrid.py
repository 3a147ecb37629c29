"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import day_number, hour_number, usable
from tidemark.operators.bars_data import current_bars


def onto_grid(readings: DataFrame, on_grid: Column | None = None, ordinal: tuple[Column, Column] | None = None, max_fill: int = 3, start: int | None = None, end: int | None = None) -> DataFrame:
    """(source, slot, value, status) for every grid slot of every source of readings (source, slot, value).

    readings hold at most one value per (source, slot); slot is an integer. From each reading the slots up to the next one
    are made: the reading itself is 'observed'; the empty ones of a gap of at most max_fill slots are 'interpolated', of a
    longer one 'missing' (value null). start and end extend each source explicitly to these slots, marked 'before' and
    'after'. on_grid: a condition on `slot` for slots that belong to the grid (readings elsewhere only bound gaps);
    ordinal: then the columns of `slot` that count grid slots, for the left and the right end of a gap.

    Scale: a source has at most one row per slot here, so a group is bounded by the length of the calendar, however many
    readings it had. lead pairs neighbours in one sort and only the times between them are exploded; no grid is joined.
    """
    w = Window.partitionBy("source").orderBy("slot")
    nxt, nval = F.lead("slot").over(w), F.lead("value").over(w)
    x = readings.where("source is not null and slot is not null and value is not null").select("source", "slot", "value", nxt.alias("nxt"), nval.alias("nval"), F.lag("slot").over(w).alias("prv"))
    left, right = ordinal or (F.col("slot"), F.col("slot"))
    between = right - F.col("left_ord") - 1
    x = x.withColumn("left_ord", left)
    parts = [F.transform(F.sequence("slot", F.coalesce(F.col("nxt") - 1, F.col("slot"))), lambda s: F.struct(s.alias("slot"), F.when(s == F.col("slot"), F.lit("observed")).otherwise(F.lit("gap")).alias("status")))]
    if start is not None:
        parts.append(F.when(F.col("prv").isNull() & (F.col("slot") > start), F.transform(F.sequence(F.lit(start).cast("bigint"), F.col("slot") - 1), lambda s: F.struct(s.alias("slot"), F.lit("before").alias("status")))))
    if end is not None:
        parts.append(F.when(F.col("nxt").isNull() & (F.col("slot") < end), F.transform(F.sequence(F.col("slot") + 1, F.lit(end).cast("bigint")), lambda s: F.struct(s.alias("slot"), F.lit("after").alias("status")))))
    empty = F.array().cast("array<struct<slot:bigint,status:string>>")
    x = x.withColumn("at", F.concat(*(F.coalesce(p, empty) for p in parts)) if len(parts) > 1 else parts[0])
    x = x.select("source", F.col("slot").alias("from_slot"), "value", "nxt", "nval", "left_ord", F.explode("at").alias("g"))
    x = x.select("source", "from_slot", "value", "nxt", "nval", "left_ord", F.col("g.slot").alias("slot"), F.col("g.status").alias("status"))
    # the width of the gap needs the right end's ordinal: computed on nxt, then the slot is restored
    x = x.withColumn("here", F.col("slot")).withColumn("slot", F.col("nxt")).withColumn("width", between).withColumn("slot", F.col("here"))
    share = (F.col("slot") - F.col("from_slot")) / (F.col("nxt") - F.col("from_slot"))
    fill = (F.col("status") == "gap") & (F.col("width") <= max_fill)
    status = F.when(F.col("status") != "gap", F.col("status")).when(fill, F.lit("interpolated")).otherwise(F.lit("missing"))
    value = F.when(F.col("status") == "observed", F.col("value")).when(fill, F.col("value") + (F.col("nval") - F.col("value")) * share)
    out = x.select("source", "slot", value.alias("value"), status.alias("status"))
    return out.where(on_grid) if on_grid is not None else out


def hourly_closes(crypto: DataFrame, max_fill: int = 3) -> DataFrame:
    """(source, slot = hours since 1970, value, status): the last usable close of each asset and clock hour.

    Of an hour the reading greatest by (bar_ts, reading_id, close) counts; redelivered rows so change nothing. Hours are
    reduced map-side before the shuffle.
    """
    r = crypto.select("asset", "bar_ts", "reading_id", usable("close").alias("close")).where("asset is not null and bar_ts is not null and close is not null")
    hours = r.groupBy(F.col("asset").alias("source"), hour_number("bar_ts").alias("slot")).agg(F.max(F.struct("bar_ts", "reading_id", "close")).alias("r"))
    return onto_grid(hours.select("source", "slot", F.col("r.close").alias("value")), max_fill=max_fill)


def weekday_closes(etf: DataFrame, max_fill: int = 3) -> DataFrame:
    """(source, slot = days since 1970, value, status): the close of each asset's last bar of each Monday to Friday.

    Weekend bars only bound the asset's range.
    """
    r = current_bars(etf, ["close"]).select("asset", "bar", day_number("bar_ts").cast("bigint").alias("slot"), usable("close").alias("close")).where("slot is not null and close is not null")
    days = r.groupBy(F.col("asset").alias("source"), "slot").agg(F.max(F.struct("bar", "close")).alias("r")).select("source", "slot", F.col("r.close").alias("value"))
    dow = F.pmod(F.col("slot") + 3, F.lit(7))  # 1970-01-01 was a Thursday; 0 is Monday
    week = F.floor((F.col("slot") + 3) / 7) * 5
    return onto_grid(days, on_grid=dow < 5, ordinal=(week + F.least(dow, F.lit(4)), week + F.least(dow, F.lit(5))), max_fill=max_fill)


def hour_text(slot: Column) -> Column:
    day = F.date_from_unix_date(F.floor(slot / 24).cast("int")).cast("string")
    return F.concat(day, F.lit(" "), F.lpad(F.pmod(slot, F.lit(24)).cast("string"), 2, "0"))


def day_text(slot: Column) -> Column:
    return F.date_from_unix_date(slot.cast("int")).cast("string")


def regular_closes(crypto: DataFrame, etf: DataFrame, max_fill: int = 3) -> DataFrame:
    """(feed, asset, slot, close, status): hourly closes of crypto_data and weekday closes of etf_data in one result."""
    h = hourly_closes(crypto, max_fill).select(F.lit("crypto_data").alias("feed"), F.col("source").alias("asset"), hour_text(F.col("slot")).alias("slot"), F.col("value").alias("close"), "status")
    d = weekday_closes(etf, max_fill).select(F.lit("etf_data").alias("feed"), F.col("source").alias("asset"), F.concat(day_text(F.col("slot")), F.lit(" 00")).alias("slot"), F.col("value").alias("close"), "status")
    return h.unionByName(d)
