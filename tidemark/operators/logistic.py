"""Walk-forward probabilities of an up move, all folds in parallel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import Keys
from tidemark.operators.features import FEATURES
from tidemark.operators.regimes import key_schema


class Logistic:
    """L2 logistic regression with strength 1/c on population-standardised features, intercept free, by Newton steps."""

    def __init__(self, c: float = 1.0, rounds: int = 50) -> None:
        self.c, self.rounds = c, rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0)
        self.sd[self.sd == 0] = 1.0
        z = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        penalty = np.append(np.full(x.shape[1], 1 / self.c), 0.0)
        w = np.zeros(z.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            grad = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), grad)
            w -= step
            if np.abs(step).max() < 1e-10:
                break
        self.w = w
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.sd
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -35, 35)))


def walk_forward_proba(df: DataFrame, keys: Keys, features: Sequence[str] = FEATURES, train: int = 756, step: int = 63, least: int = 504, model: Callable = Logistic) -> DataFrame:
    """(keys, bar, prob, outcome): out-of-sample probabilities from row `least` of each key's complete rows on.

    df: (keys, bar, features, target), complete rows. Fold f predicts the rows [least + f step, least + (f + 1) step) from
    the up to `train` rows before them, if these number at least `least` and hold both classes. Each row goes to the folds
    that use it, train / step + 2 at most, and every (keys, fold) is one bounded task.
    """
    keys, features = list(keys), list(features)
    from pyspark.sql import Window

    d = df.select(*keys, "bar", *features, F.col("target").cast("double").alias("target")).withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("bar")) - 1)
    first = F.greatest(F.floor((F.col("row") - least) / step), F.lit(0))
    last = F.floor((F.col("row") + train - least) / step)
    d = d.withColumn("fold", F.explode(F.sequence(first.cast("int"), F.greatest(last, first).cast("int"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        start = least + int(pdf["fold"].iloc[0]) * step
        past = pdf[(pdf["row"] < start) & (pdf["row"] >= start - train)].sort_values("row")
        now = pdf[(pdf["row"] >= start) & (pdf["row"] < start + step)].sort_values("row")
        if len(now) == 0 or len(past) < least or past["target"].nunique() < 2:
            return now.head(0)[[*keys, "bar"]].assign(prob=pd.Series(dtype=float), outcome=pd.Series(dtype=float))
        m = model().fit(past[features].to_numpy(float), past["target"].to_numpy(float))
        return now[[*keys, "bar"]].assign(prob=m.predict_proba(now[features].to_numpy(float)), outcome=now["target"])

    bar = df.schema["bar"].dataType.simpleString()
    return d.groupBy(*keys, "fold").applyInPandas(one, f"{key_schema(df, keys)}, bar {bar}, prob double, outcome double")
