"""Statistics by region and season, joined back with fallbacks.

A climatology has one row for each region and month, or week: it grows with the regions, not with the days. Joins leave the
choice of the physical join to Spark, which broadcasts a side when its size allows that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import future_month
from ..functions.measures import at_least
from .quantiles import quantiles

KEY, ORDER = "region_id", "ordinal"


def means(rows: DataFrame, keys: Sequence[str], column: str = "score", to: str = "mean_score") -> DataFrame:
    keyed = rows.filter(" and ".join(f"{k} is not null" for k in keys))
    return keyed.groupBy(*keys).agg(F.avg(column).alias(to))


def region_statistics(panel: DataFrame) -> DataFrame:
    """Mean, median and deviation of the score; the deviation of a single score is 0."""
    return panel.groupBy(KEY).agg(F.avg("score").alias("region_mean"), F.median("score").alias("region_median"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("region_std"))


def region_medians(panel: DataFrame) -> DataFrame:
    """Median score by region; the median of all scores where a region has none."""
    whole = F.lit(quantiles(panel, {"all": ("score", 0.5)})["all"]).cast("double")
    return panel.groupBy(KEY).agg(F.coalesce(F.median("score"), whole).alias("median_score"))


def monthly(rows: DataFrame, columns: Sequence[str], floor: float | None = None, keys: Sequence[str] = (KEY, "month")) -> DataFrame:
    """Mean and deviation of `columns` as <column>_m and <column>_s."""
    spread = lambda c: F.stddev_samp(c) if floor is None else at_least(F.stddev_samp(c), floor)
    return rows.groupBy(*keys).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_m"), spread(c).alias(f"{c}_s"))))


def with_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(table, list(keys), "left")


SPI = (("prec", 30), ("prec", 90), ("prec", 180), ("tmp", 90))


def spi_statistics(weekly: DataFrame, parts: Sequence[tuple[str, int]] = SPI) -> DataFrame:
    return monthly(weekly, [f"{c}_roll{w}_mean" for c, w in parts], 0.1)


def spi(df: DataFrame, statistics: DataFrame, parts: Sequence[tuple[str, int]] = SPI) -> DataFrame:
    """Adds <column>_spi<width>: the rolling mean against its month's mean and deviation in the region."""
    joined = with_lookup(df, statistics, (KEY, "month"))
    scores = [((F.col(f"{c}_roll{w}_mean") - F.col(f"{c}_roll{w}_mean_m")) / F.col(f"{c}_roll{w}_mean_s")).alias(f"{c}_spi{w}") for c, w in parts]
    return joined.select(*df.columns, *scores)


def zscores(df: DataFrame, climatology: DataFrame, columns: Sequence[str], fallback: bool = False) -> DataFrame:
    """Adds <column>_z. Deviations that are missing or under 1e-8 count as 1.

    With `fallback`, keys that the climatology lacks take the mean and deviation over all its rows.
    """
    joined = with_lookup(df, climatology, (KEY, "month"))
    if fallback:
        whole = climatology.agg(*(F.avg(f"{c}_{x}").alias(f"_{c}_{x}") for c in columns for x in "ms"))
        joined = joined.join(F.broadcast(whole))

    def z(c: str):
        m, s = F.col(f"{c}_m"), F.col(f"{c}_s")
        if fallback:
            m, s = F.coalesce(m, F.col(f"_{c}_m")), F.coalesce(s, F.col(f"_{c}_s"))
        return ((F.col(c) - m) / F.when(s < 1e-8, F.lit(1.0)).otherwise(F.coalesce(s, F.lit(1.0)))).alias(f"{c}_z")

    return joined.select(*df.columns, *map(z, columns))


def seasonal_deviation(df: DataFrame, columns: Sequence[str], month: str = "month") -> DataFrame:
    w = Window.partitionBy(KEY, month)
    return df.select("*", *((F.col(c) - F.avg(c).over(w)).alias(f"{c}_seasonal_dev") for c in columns))


def seasonal_mean(df: DataFrame, rows: DataFrame, month: str = "month", to: str = "regional_seasonal_mean", season: str = "month") -> DataFrame:
    """Adds the mean score of the region's month (or other season); the region's mean where it has none, else 0."""
    by_season = means(rows, (KEY, season), to="_seasonal").withColumnRenamed(season, "_season")
    by_region = means(rows, (KEY,), to="_regional")
    joined = df.withColumn("_season", F.col(month)).join(by_season, [KEY, "_season"], "left").join(by_region, [KEY], "left")
    return joined.select(*df.columns, F.coalesce("_seasonal", "_regional", F.lit(0.0)).alias(to))


def seasonal_forward(weekly: DataFrame, rows: DataFrame, weeks: int = 5) -> DataFrame:
    """Adds rsm_fw_wk1..: seasonal means of the months of the next weekly rows, the last row's beyond the end."""
    o = Window.partitionBy(KEY).orderBy(ORDER)
    end = F.last("month").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = weekly.select("*", *(F.coalesce(F.lead("month", k).over(o), end).alias(f"_m{k}") for k in range(1, weeks + 1)))
    return _forward(out, rows, weeks)


def seasonal_forward_test(tests: DataFrame, rows: DataFrame, weeks: int = 5) -> DataFrame:
    """The same for rows without followers: months by the calendar."""
    out = tests.select("*", *(future_month(F.col("month"), F.col("day"), k).alias(f"_m{k}") for k in range(1, weeks + 1)))
    return _forward(out, rows, weeks)


def _forward(out: DataFrame, rows: DataFrame, weeks: int) -> DataFrame:
    """rsm_fw_wk1.. from _m1..: one row for each region with its months' means, joined once."""
    scored = rows.filter(F.col(KEY).isNotNull())
    by_month = scored.groupBy(KEY, "month").agg(F.avg("score").alias("_mean"), F.sum("score").alias("_sum"), F.count("score").alias("_count"))
    season = F.map_from_entries(F.collect_list(F.when(F.col("month").isNotNull() & F.col("_mean").isNotNull(), F.struct("month", "_mean")))).alias("_season")  # twelve months at most
    by_region = by_month.groupBy(KEY).agg(season, F.try_divide(F.sum("_sum"), F.sum("_count")).alias("_regional"))
    joined = out.join(by_region, [KEY], "left")
    means = (F.coalesce(F.col("_season")[F.col(f"_m{k}")], F.col("_regional"), F.lit(0.0)).alias(f"rsm_fw_wk{k}") for k in range(1, weeks + 1))
    return joined.select(*(c for c in out.columns if c not in {f"_m{k}" for k in range(1, weeks + 1)}), *means)
