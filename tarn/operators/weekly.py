"""From days to weeks: the last labelled day of each week bucket, recency and test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import ORDINAL_PER_YEAR, week_bucket

KEY, ORDER = "region_id", "ordinal"


def last_rows(df: DataFrame, keys: Sequence, n: int = 1) -> DataFrame:
    """The `n` latest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ORDER)))
    return df.withColumn("_nth", rank).filter(F.col("_nth") <= n).drop("_nth")


def tails(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each region's latest day with `columns`: one aggregate, combined before the shuffle."""
    last = F.max_by(F.struct(ORDER, *columns), F.col(ORDER)).alias("_last")
    return df.groupBy(KEY).agg(last).select(KEY, f"_last.{ORDER}", *(F.col(f"_last.`{c}`") for c in columns))


def labelled(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("score").isNotNull())


def to_weekly(days: DataFrame) -> DataFrame:
    return last_rows(days, [KEY, week_bucket(F.col(ORDER))])


def recent(df: DataFrame, years: int) -> DataFrame:
    """Rows of the last years of each region."""
    last = F.max(ORDER).over(Window.partitionBy(KEY))
    return df.withColumn("_last", last).filter(F.col(ORDER) >= F.col("_last") - years * ORDINAL_PER_YEAR).drop("_last")


def since(df: DataFrame, cutoff: int) -> DataFrame:
    return df.filter(F.col(ORDER) >= cutoff)


def numbered(df: DataFrame) -> DataFrame:
    """Adds i, the row's place in its region from 0, and n, the region's rows."""
    o = Window.partitionBy(KEY).orderBy(ORDER)
    return df.select("*", (F.row_number().over(o) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy(KEY)).alias("n"))


def at_least_rows(df: DataFrame, least: int = 6) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(KEY))).filter(F.col("_n") >= least).drop("_n")


def hide_last(panel: DataFrame, days: int = 91) -> DataFrame:
    """Adds split: the last days of each region are 'test' and lose their score."""
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(ORDER)))
    test = F.col("_nth") <= days
    out = panel.withColumn("_nth", rank).withColumns({"split": F.when(test, "test").otherwise("train"), "score": F.when(~test, F.col("score"))})
    return out.drop("_nth")


def union_panels(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)
