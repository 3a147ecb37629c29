"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import genuine_date, norm_key, number, second_number
from tidemark.functions.prefix import even_blocks, running
from tidemark.operators.filings import distinct_filings
from tidemark.session import cut


def time_span(times: DataFrame) -> tuple[int, int, int]:
    """(first second, last second, rows) of a frame with one column t, by one aggregate."""
    low, high, n = times.select(second_number("t").alias("t")).agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    return (low, high, n) if low is not None else (0, 0, 0)


def known_at(facts: DataFrame, events: DataFrame, entity: str, known_from: str, rank: Sequence[str], event_id: str, event_ts: str, attributes: Sequence[str], span: tuple[int, int, int] | None = None) -> DataFrame:
    """events (event_id, event_ts, entity) with the attributes of the greatest fact by rank among those known by then.

    facts: (entity, known_from, rank columns, attributes), rank unique within an entity. A fact is a new version if it
    outranks all known before it; versions get a number per entity, events the count of versions up to their time, both by
    cumulative counts over narrow timestamp rows; wide attributes then join on (entity, number). Events before any version
    give no row. Rows with null entity or time are left out; an event at exactly known_from sees the fact.

    Scale: both scans run in blocks of time (functions.prefix), so no entity becomes one task. span, (first second, last second,
    rows), sets the blocks; it is counted beforehand if it isn't given, and only has to be roughly right. The join's key is
    the entity's version, and AQE splits versions that many events share.
    """
    if span is None:
        span = time_span(facts.select(F.col(known_from).alias("t")).unionByName(events.select(F.col(event_ts).alias("t"))))
    block = lambda ts: even_blocks(second_number(ts), *span)
    f = facts.select(F.col(entity).alias("__k"), F.col(known_from).alias("__ts"), F.struct(*rank).alias("__rank"), F.struct(*attributes).alias("__attr"))
    f = f.withColumn("__block", block("__ts"))
    best = running(f, ["__k"], "__block", ["__ts", "__rank"], {"__best": ("max", F.col("__rank"))})
    changes = cut(best.where(F.col("__rank") == F.col("__best")).select("__k", "__ts", "__rank", "__block", "__attr"))
    versions = running(changes, ["__k"], "__block", ["__ts", "__rank"], {"__no": ("sum", F.lit(1))}).select("__k", "__no", "__attr")

    marks = changes.select("__k", "__ts", "__block", F.lit(0).alias("__kind"), F.lit(None).cast("bigint").alias("__id"))
    asks = events.select(F.col(entity).alias("__k"), F.col(event_ts).alias("__ts"), block(event_ts).alias("__block"), F.lit(1).alias("__kind"), F.col(event_id).cast("bigint").alias("__id"))
    timeline = running(marks.unionByName(asks), ["__k"], "__block", ["__ts", "__kind", "__id"], {"__no": ("sum", 1 - F.col("__kind"))})
    numbered = timeline.where((F.col("__kind") == 1) & (F.col("__no") > 0)).select("__k", "__no", F.col("__id").alias(event_id), F.col("__ts").alias(event_ts))
    return numbered.join(versions, ["__k", "__no"]).select(event_id, event_ts, F.col("__k").alias(entity), F.col("__no").alias("version"), *(F.col(f"__attr.{a}").alias(f"known_{a}") for a in attributes))


def rebalances_with_pb(fundamentals: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Each rebalance with the filing that gave its ticker's pb as known at rebal_ts.

    A filing is known once it is public (the day date_filed has begun) and delivered; among the known ones the greatest by
    (date_filed, loaded_at, filing_id) counts. Repeated rebalance rows count once. (rebal_id, rebal_ts, ticker, version,
    known_filing_id, known_pb, known_date_filed, known_loaded_at)
    """
    f = distinct_filings(fundamentals, ["date_filed", "pb"]).withColumns({"date_filed": genuine_date(), "pb": number("pb")})
    f = f.where("date_filed is not null and pb is not null and loaded_at is not null")
    f = f.withColumn("known_from", F.greatest(F.col("loaded_at"), F.col("date_filed").cast(f.schema["loaded_at"].dataType)))
    e = rebalances.where("rebal_id is not null and rebal_ts is not null and ticker is not null").groupBy("rebal_id").agg(F.min("rebal_ts").alias("rebal_ts"), F.min(norm_key("ticker")).alias("ticker"))
    # the tables as they are, narrow: filings become known from their loaded_at on
    span = time_span(fundamentals.select(F.col("loaded_at").alias("t")).unionByName(rebalances.select(F.col("rebal_ts").alias("t"))))
    return known_at(f, e, "ticker", "known_from", ["date_filed", "loaded_at", "filing_id"], "rebal_id", "rebal_ts", ["filing_id", "pb", "date_filed", "loaded_at"], span)
