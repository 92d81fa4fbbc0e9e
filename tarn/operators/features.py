"""Feature sets: which lags, rolling statistics, indices and seasonal means a model sees."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import cyclic
from ..functions.measures import at_least
from .frames import CHUNK, Prior, over_chunks, with_priors
from .rolling import MinRows, dry_days, lags, prior, tenth

# fixed values: the columns of the daily weather panel
WEATHER = ("prec", "surf_pre", "humidity", "tmp", "dp_tmp", "wb_tmp", "tmp_max", "tmp_min", "tmp_range", "surf_tmp", "wind", "wind_max", "wind_min", "wind_range")
# fixed values: the derived indices, in the order that models see
INDICES = ("prec_deficit_90d", "prec_trend_30d", "humidity_deficit_90d", "tmp_anomaly_90d", "heat_drought_idx", "dry_days_14d", "dry_days_30d")


def deficit(column: str) -> Column:
    """Mean of 90 prior rows less the mean of 365."""
    return prior(column, "mean", 90, 30) - prior(column, "mean", 365, 60)


def robust_deficit(column: str) -> Column:
    return prior(column, "mean", 90, 30) - prior(column, "median", 90, 30)


def trend(column: str) -> Column:
    return (prior(column, "mean", 7, 3) - prior(column, "mean", 30, 10)) / at_least(prior(column, "std", 30, 10), 0.01)


#: What the indices are made of: means of a quarter and a year, and the shape of the last month's rain.
PARTS = [Prior(c, "mean", w, least, f"__{c}_{w}") for c in ("prec", "humidity", "tmp") for w, least in ((90, 30), (365, 60))]
PARTS += [Prior("prec", "mean", 7, 3, "__prec_7"), Prior("prec", "mean", 30, 10, "__prec_30"), Prior("prec", "std", 30, 10, "__prec_std")]


def indices(df: DataFrame) -> DataFrame:
    """The indices in place of their parts."""
    gap = lambda c: F.col(f"__{c}_90") - F.col(f"__{c}_365")
    heat = gap("prec") * at_least(gap("tmp"), 0.0)
    rain = (F.col("__prec_7") - F.col("__prec_30")) / at_least(F.col("__prec_std"), 0.01)
    named = [gap("prec").alias("prec_deficit_90d"), rain.alias("prec_trend_30d"), gap("humidity").alias("humidity_deficit_90d"), gap("tmp").alias("tmp_anomaly_90d"), heat.alias("heat_drought_idx")]
    return dry_days(df.select("*", *named).drop(*(p.name for p in PARTS)))


@dataclass(frozen=True)
class FeatureSet:
    """One version of the features; `names` is the order that models see."""

    raw: tuple[str, ...] = WEATHER
    # fixed values: columns, steps and widths of the published feature list
    lag_columns: tuple[str, ...] = ("tmp_range", "tmp_max", "tmp", "prec", "wind", "surf_pre", "humidity")
    lag_steps: tuple[int, ...] = (1, 3, 7, 14, 21)
    roll_columns: tuple[str, ...] = ("prec", "humidity", "tmp", "wind", "surf_pre", "dp_tmp")
    roll_widths: tuple[int, ...] = (7, 14, 30, 60, 90, 180)
    stats: tuple[str, ...] = ("mean", "std", "max")
    least: MinRows = tenth
    with_indices: bool = True
    regional_mean: bool = True
    seasonal_mean: bool = True
    seasonal_forward: int = 5
    spi: tuple[tuple[str, int], ...] = (("prec", 30), ("prec", 90), ("prec", 180), ("tmp", 90))

    @property
    def names(self) -> list[str]:
        out = [*self.raw, *(f"{c}_lag{k}" for c in self.lag_columns for k in self.lag_steps), *(f"{c}_roll{w}_{s}" for c in self.roll_columns for w in self.roll_widths for s in self.stats)]
        out += ["month_sin", "month_cos", "day_sin", "day_cos"]
        out += INDICES if self.with_indices else ()
        out += ["regional_mean_score"] * self.regional_mean + ["regional_seasonal_mean"] * self.seasonal_mean
        return out + [f"rsm_fw_wk{k}" for k in range(1, self.seasonal_forward + 1)] + [f"{c}_spi{w}" for c, w in self.spi]

    def daily(self, panel: DataFrame, chunk: int = CHUNK) -> DataFrame:
        """The panel with all features that depend on a region's own days; long histories go by chunks of days."""
        month, day = cyclic(F.col("month"), 12), cyclic(F.col("day"), 31)
        named = [c.alias(n) for c, n in zip((*month, *day), ("month_sin", "month_cos", "day_sin", "day_cos"), strict=True)]
        have = set(panel.columns)
        lagged = lags([c for c in self.lag_columns if c in have], self.lag_steps)
        wanted = [Prior(c, s, w, self.least(w), f"{c}_roll{w}_{s}") for c in self.roll_columns if c in have for w in self.roll_widths for s in self.stats]
        wanted += PARTS if self.with_indices else []

        def build(days: DataFrame) -> DataFrame:
            out = with_priors(days.select("*", *named, *lagged), wanted)
            return indices(out) if self.with_indices else out

        return over_chunks(panel, max([1, *(p.width for p in wanted), *self.lag_steps]), build, chunk)


FULL = FeatureSet()
# fixed values: what the published versions leave out
VERSIONS = {
    "v31": FULL,
    "v30": replace(FULL, spi=()),
    "v29": replace(FULL, roll_columns=("prec", "humidity", "tmp", "wind"), spi=()),
    "v27": replace(FULL, roll_columns=("prec", "humidity", "tmp", "wind"), spi=(), seasonal_mean=False, seasonal_forward=0),
    "v24": replace(FULL, roll_columns=("prec", "humidity", "tmp", "wind"), spi=(), seasonal_forward=0),
}


def ensure_features(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` with a column of zeros for every missing feature."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})
