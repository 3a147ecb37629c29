"""Aggregates of net return streams, as column builders for groupBy().agg()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(r: Column | str) -> Column:
    return F.col(r) if isinstance(r, str) else r


def finite(r: Column | str) -> Column:
    r = _c(r)
    return F.when(r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")), r)


def profit_factor(r: Column | str) -> Column:
    """Gains over losses; without losses infinity if there are gains, else 1."""
    r = finite(r)
    wins, losses = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0))
    return F.when(losses <= 1e-12, F.when(wins > 0, float("inf")).otherwise(1.0)).otherwise(F.try_divide(wins, losses))


def sharpe(r: Column | str, periods: int = 252, population: bool = False) -> Column:
    r = finite(r)
    sd = F.stddev_pop(r) if population else F.stddev_samp(r)
    return F.when(F.coalesce(sd, F.lit(0.0)) <= 1e-12, 0.0).otherwise(F.try_divide(F.avg(r), sd) * periods**0.5)


def total_return_pct(r: Column | str) -> Column:
    return F.coalesce(F.expm1(F.sum(F.log1p(F.greatest(finite(r), F.lit(-0.999999))))), F.lit(0.0)) * 100


def mean_bps(r: Column | str) -> Column:
    return F.coalesce(F.avg(finite(r)) * 1e4, F.lit(0.0))


def annual_vol(r: Column | str, periods: int = 252) -> Column:
    return F.stddev_pop(finite(r)) * periods**0.5


def p_value(real: Column | str, permuted: Column | str) -> Column:
    """Add-one p-value over permutation rows."""
    return (1 + F.sum(F.when(_c(permuted) >= _c(real) - 1e-12, 1).otherwise(0))) / (1 + F.count(permuted))


def brier(p: Column | str, o: Column | str) -> Column:
    return F.avg(F.pow(_c(p) - _c(o), 2))


def qlike(f: Column | str, v: Column | str) -> Column:
    """mean(v/f - ln(v/f) - 1) where both exceed 1e-12."""
    f, v = _c(f), _c(v)
    ratio = F.when((f > 1e-12) & (v > 1e-12), F.try_divide(v, f))
    return F.avg(ratio - F.ln(ratio) - 1)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows with both; null if either is constant."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-15) & (sy > 1e-15), F.try_divide(F.covar_pop(x, y), sx * sy))


def lag1_autocorr(x: Column | str, mean: Column | str, nxt: Column | str) -> Column:
    """Sum of x_t x_t+1 over sum of x^2, both less the sample's mean; 0 for a constant. nxt is the following value."""
    x, mean, nxt = _c(x), _c(mean), _c(nxt)
    den = F.sum(F.pow(x - mean, 2))
    return F.when(den <= 1e-12, 0.0).otherwise(F.try_divide(F.sum((x - mean) * (nxt - mean)), den))
