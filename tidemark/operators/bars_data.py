"""Versions of bars and readings: what counts as the current value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_bars(etf: DataFrame, values: Sequence[str]) -> DataFrame:
    """(asset, bar, bar_ts, values): of each (asset, bar) the version with the latest loaded_at.

    Exact copies collapse; should versions share loaded_at, the greatest values count. A null loaded_at is the oldest.
    Rows without asset or bar are left out. Hash aggregation by (asset, bar), so no asset is a hot key.
    """
    best = etf.where("asset is not null and bar is not null").groupBy("asset", "bar").agg(F.max(F.struct("loaded_at", "bar_ts", *values)).alias("r"))
    return best.select("asset", "bar", "r.bar_ts", *(F.col(f"r.{v}") for v in values))
