"""Lags, means and trends of past scores on weekly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "region_id", "ordinal"


def _o():
    return Window.partitionBy(KEY).orderBy(ORDER)


def score_lags(weekly: DataFrame, k: int) -> DataFrame:
    """score_lag1 is the current score; a missing lag takes the one before it."""
    names, out = [], weekly.select("*", *(F.lag("score", j).over(_o()).alias(f"_l{j}") for j in range(k)))
    for j in range(k):
        names.append(F.coalesce(*(F.col(f"_l{x}") for x in range(j, -1, -1))).alias(f"score_lag{j + 1}"))
    return out.select(*weekly.columns, *names)


def score_lags_gap(weekly: DataFrame, gap: int = 13, k: int = 3) -> DataFrame:
    """Lags behind a gap; missing ones are 0."""
    return weekly.select("*", *(F.coalesce(F.lag("score", gap + j).over(_o()), F.lit(0.0)).alias(f"score_lag{j + 1}") for j in range(k)))


def last_scores(weekly: DataFrame, k: int) -> DataFrame:
    """The last k scores of each region, newest first; the first score where there are fewer."""
    back = Window.partitionBy(KEY).orderBy(F.desc(ORDER))
    ranked = weekly.select(KEY, "score", F.row_number().over(back).alias("nth"), F.last("score").over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    return ranked.groupBy(KEY).agg(*(F.coalesce(F.max(F.when(F.col("nth") == j, F.col("score"))), F.max("first")).alias(f"score_lag{j}") for j in range(1, k + 1)))


def score_windows(weekly: DataFrame) -> DataFrame:
    """Means of 4 and 8 weeks and deviation of 4, with the current one."""
    four, eight = _o().rowsBetween(-3, 0), _o().rowsBetween(-7, 0)
    return weekly.select("*", F.avg("score").over(four).alias("score_mean_4w"), F.coalesce(F.stddev_samp("score").over(four), F.lit(0.0)).alias("score_std_4w"), F.avg("score").over(eight).alias("score_mean_8w"))


def score_history(weekly: DataFrame, dry: float = 1.0) -> DataFrame:
    """Prior means, trend, and counts of prior weeks with a score or without rain among 12."""
    o = _o()
    twelve = o.rowsBetween(-12, -1)
    count = lambda hit: F.coalesce(F.sum(F.when(hit, 1.0).otherwise(0.0)).over(twelve), F.lit(0.0))
    return weekly.select(
        "*",
        F.coalesce(F.avg("score").over(o.rowsBetween(-4, -1)), F.lit(0.0)).alias("score_mean_4w_prior"),
        F.coalesce(F.lag("score", 1).over(o) - F.lag("score", 4).over(o), F.lit(0.0)).alias("score_trend_4w"),
        count(F.col("score") > 0).alias("score_streak"),
        count(F.col("prec") < dry).alias("prec_weeks_dry"),
    )


def trajectory(weekly: DataFrame, columns: list[str], weeks: int = 12) -> DataFrame:
    return weekly.select("*", *(F.coalesce(F.col(c) - F.lag(c, weeks).over(_o()), F.lit(0.0)).alias(f"traj_{c}") for c in columns))


def trajectory_test(weekly: DataFrame, columns: list[str]) -> DataFrame:
    """Last weekly row less the first, by region."""
    return weekly.groupBy(KEY).agg(*((F.max_by(c, ORDER) - F.min_by(c, ORDER)).alias(f"traj_{c}") for c in columns))
