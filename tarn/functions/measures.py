"""Scalar measures and null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_MAX = 5.0


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def coerce(x: Column) -> Column:
    """A number, or null for text that is none and for NaN."""
    return nan_to_null(x.try_cast("double"))


def at_least(x: Column, low: float) -> Column:
    """x, but not below `low`; null stays null, unlike with greatest()."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def clip_score(x: Column) -> Column:
    return clip(x, 0.0, SCORE_MAX)


def ratio(x: Column, y: Column) -> Column:
    """x / y; NaN where y is 0, as 0 / 0 is."""
    return F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, y))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation, an aggregate over rows that have both: NaN where one side never varies, null without rows."""
    both = x.isNotNull() & y.isNotNull()
    return ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


# fixed values: weights of score bands [1, 2), [2, 3) and [3, ...)
BAND_WEIGHTS = (1.3, 1.2, 1.1)
BAND_WEIGHTS_STRONG = (2.0, 1.5, 1.2)


def band_weight(score: Column, bands: tuple[float, float, float] = BAND_WEIGHTS) -> Column:
    one, two, three = map(F.lit, bands)
    return F.when(score >= 3, three).when(score >= 2, two).when(score >= 1, one).otherwise(F.lit(1.0))


def linear_weight(score: Column) -> Column:
    return clip(1 + score / 2.5, 1.0, 3.0)


def band(score: Column) -> Column:
    """0 for [0, 1), 1 for [1, 2), ... 4 for [4, 5]."""
    return F.when(score >= 0, F.least(F.floor(score), F.lit(4)))


def vpd_magnus(tmp: Column, humidity: Column) -> Column:
    """Vapour pressure deficit in hPa, not below 0."""
    return at_least(6.112 * F.exp(17.67 * tmp / (tmp + 243.5)) * (1 - humidity / 100), 0.0)


def vpd_tetens(tmp: Column, humidity: Column) -> Column:
    """Vapour pressure deficit in kPa."""
    full = 0.6108 * F.exp(17.27 * tmp / (tmp + 237.3))
    return full - full * (humidity / 100)


def aet_proxy(tmp: Column, wind: Column, humidity: Column) -> Column:
    return tmp * wind / (humidity + 1)
