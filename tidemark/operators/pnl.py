"""Cost model and net returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import Keys, bar_return, lag, upto


@dataclass(frozen=True)
class Costs:
    """Costs in basis points of one unit of turnover."""

    commission_bps: float = 1.0
    slippage_bps: float = 2.0

    @property
    def per_turn(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 1e4


def strategy_returns(df: DataFrame, keys: Keys, costs: Costs = Costs(), price: str = "close") -> DataFrame:
    """df (keys, bar, price, position) with net: the position held into the bar earns its return, a change of position
    costs on the bar that decides it; the first bar neither earns nor pays."""
    prev = lag("position", keys)
    turn = F.coalesce(F.abs(F.col("position") - prev), F.lit(0.0))
    return df.withColumn("net", F.coalesce(prev, F.lit(0.0)) * bar_return(price, keys) - turn * costs.per_turn)


def prelagged_returns(df: DataFrame, keys: Keys, ret: str, costs: Costs = Costs()) -> DataFrame:
    """net for positions that are already built from the bar before: return and cost fall on the same bar."""
    turn = F.abs(F.col("position") - F.coalesce(lag("position", keys), F.lit(0.0)))
    return df.withColumn("net", F.col("position") * F.col(ret) - turn * costs.per_turn)


def pair_returns(df: DataFrame, keys: Keys, costs: Costs = Costs()) -> DataFrame:
    """net of a dollar-neutral pair (ret_a, ret_b, position): two legs, two costs."""
    prev = lag("position", keys)
    turn = F.coalesce(F.abs(F.col("position") - prev), F.lit(0.0))
    return df.withColumn("net", F.coalesce(prev, F.lit(0.0)) * (F.col("ret_a") - F.col("ret_b")) - turn * costs.per_turn * 2)


def round_trip_returns(df: DataFrame, gross: str, costs: Costs = Costs(), turns: float = 1.0) -> DataFrame:
    """net of a trade that is opened and closed every bar."""
    return df.withColumn("net", F.col(gross) - 2 * costs.per_turn * turns)


def portfolio_returns(df: DataFrame, keys: Keys, scenario: Keys = (), costs: Costs = Costs()) -> DataFrame:
    """(scenario, bar, net) of weights per asset (keys, bar, ret, weight): yesterday's weights earn, changes cost; summed
    over assets, missing returns skipped."""
    prev = F.coalesce(lag("weight", keys), F.lit(0.0))
    legs = df.select(*dict.fromkeys([*scenario, "bar"]), (prev * F.coalesce(F.col("ret"), F.lit(0.0)) - F.abs(F.col("weight") - prev) * costs.per_turn).alias("leg"))
    return legs.groupBy(*scenario, "bar").agg(F.sum("leg").alias("net"))


def drawdown(df: DataFrame, keys: Keys, net: str = "net") -> DataFrame:
    """df with equity and drawdown; the peak starts at the first equity."""
    df = df.withColumn("equity", F.exp(F.sum(F.log1p(F.greatest(F.coalesce(F.col(net), F.lit(0.0)), F.lit(-0.999999)))).over(upto(keys))))
    return df.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(upto(keys))) - 1)
