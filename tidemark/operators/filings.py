"""Deliveries of filings: what counts as one filing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import norm_key


def distinct_filings(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row per filing_id: (filing_id, ticker normalised, loaded_at the earliest, columns).

    Copies of a filing carry the same values; should they differ, the earliest delivery counts, then the largest values.
    Rows without filing_id or ticker belong to no filing and no ticker and are left out. Hash aggregation by filing_id with
    map-side combine, so no ticker becomes a hot key.
    """
    rows = df.select("filing_id", norm_key("ticker").alias("ticker"), "loaded_at", *columns).where("filing_id is not null and ticker is not null")
    # the earliest first, then the largest values: order by the negated age of the delivery
    age = -F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(2**62))
    best = rows.groupBy("filing_id").agg(F.max(F.struct(age.alias("age"), "ticker", *columns)).alias("r"), F.min("loaded_at").alias("loaded_at"))
    return best.select("filing_id", "r.ticker", "loaded_at", *(F.col(f"r.{c}") for c in columns))
