"""Causal recursions over streams of bars: the EWMA variance and the regime filter as stateful operators.

An extension: rows arrive in event order per key, state is one small tuple per key, and the results equal those of the batch
operators on the same bars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.regimes import Model


def stream_ewma(bars: DataFrame, lam: float = 0.94) -> DataFrame:
    """(asset, bar, ret, variance): the forecast before each bar, v <- lam v + (1 - lam) ret^2 from the first return's square.

    bars (asset, bar, ret). Late bars (bar not beyond the last one seen) are dropped.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, v = state.get if state.exists else (-1, None)
        pdf = pd.concat(list(batches)).sort_values("bar")
        rows = []
        for bar, x in zip(pdf["bar"].tolist(), pdf["ret"].fillna(0.0).tolist()):
            if bar <= last:
                continue
            rows.append((key[0], bar, x, v))
            v = x * x if v is None else lam * v + (1 - lam) * x * x
            last = bar
        state.update((last, v))
        yield pd.DataFrame(rows, columns=["asset", "bar", "ret", "variance"])

    return bars.groupBy("asset").applyInPandasWithState(update, "asset string, bar bigint, ret double, variance double", "last bigint, v double", "append", GroupStateTimeout.NoTimeout)


def stream_filter(bars: DataFrame, model: Model) -> DataFrame:
    """(asset, bar, ret, regime, belief): the regime filter of one model over every asset's stream."""
    k = len(model.mean)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *prior = state.get if state.exists else (-1, *model.start.tolist())
        p = np.array(prior)
        pdf = pd.concat(list(batches)).sort_values("bar")
        rows = []
        for bar, x in zip(pdf["bar"].tolist(), pdf["ret"].fillna(0.0).tolist()):
            if bar <= last:
                continue
            d = model.log_density(np.array([x]))[0]
            p = p * np.exp(d - d.max())
            p = p / p.sum() if p.sum() > 0 else np.full(k, 1.0 / k)
            rows.append((key[0], bar, x, int(p.argmax()), p.tolist()))
            p, last = p @ model.trans, bar
        state.update((last, *p.tolist()))
        yield pd.DataFrame(rows, columns=["asset", "bar", "ret", "regime", "belief"])

    states = ", ".join(["last bigint", *(f"p{i} double" for i in range(k))])
    return bars.groupBy("asset").applyInPandasWithState(update, "asset string, bar bigint, ret double, regime int, belief array<double>", states, "append", GroupStateTimeout.NoTimeout)
