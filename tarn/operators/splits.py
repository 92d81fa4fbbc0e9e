"""Forecast windows, and the ways to split them into training and validation.

A window is weekly row i of a region with n rows and the scores of the next five rows, y1..y5, so it needs i < n - 5.
Random choices are orders by md5 of key and seed, which other engines can repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .weekly import numbered

KEY, ORDER = "region_id", "ordinal"
HORIZONS = 5
YS = [f"y{k}" for k in range(1, HORIZONS + 1)]


def windows(weekly: DataFrame, stride: int = 1) -> DataFrame:
    """Adds i, n and y1..y5; every stride-th window of a region and its last."""
    o = Window.partitionBy(KEY).orderBy(ORDER)
    aimed = numbered(weekly).select("*", *(F.lead("score", k).over(o).alias(f"y{k}") for k in range(1, HORIZONS + 1)))
    out = aimed.filter(F.col("i") < F.col("n") - HORIZONS)
    return out if stride == 1 else out.filter((F.col("i") % stride == 0) | (F.col("i") == F.col("n") - HORIZONS - 1))


def mean_target(w: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return w.withColumn("y", sum((F.col(f"y{k}") for k in horizons[1:]), F.col(f"y{horizons[0]}")) / len(horizons))


def drawn(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def choose(keys: DataFrame, share: float, seed: int, stratum: str | None = None) -> DataFrame:
    """A share of the keys, of each stratum at least one."""
    part = Window.partitionBy(stratum) if stratum else Window.partitionBy()
    rank = F.row_number().over(part.orderBy(drawn(F.col(KEY), seed), KEY))
    many = F.greatest(F.lit(1), F.floor(F.count("*").over(part) * share))
    return keys.withColumn("_rank", rank).withColumn("_many", many).filter(F.col("_rank") <= F.col("_many")).drop("_rank", "_many")


def random_regions(weekly: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    return choose(weekly.select(KEY).distinct(), share, seed)


def quartiles(weekly: DataFrame) -> DataFrame:
    """mean_score and quartile (0..3, right-closed) of each region; equal edges count once."""
    scored = weekly.groupBy(KEY).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
    edges = scored.agg(F.percentile("mean_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_edges"), F.min("mean_score").alias("_low"), F.max("mean_score").alias("_high"))
    inner = F.filter(F.array_distinct("_edges"), lambda e: (e > F.col("_low")) & (e < F.col("_high")))
    below = F.size(F.filter(inner, lambda e: e < F.col("mean_score")))
    return scored.join(F.broadcast(edges)).select(KEY, "mean_score", below.cast("long").alias("quartile"))


def stratified_regions(weekly: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    return choose(quartiles(weekly), share, seed, "quartile").select(KEY, "quartile")


def holdout(w: DataFrame, held: DataFrame) -> DataFrame:
    """Adds part: 'val' is the last window of each held-out region, 'train' all windows of the others."""
    marked = w.join(held.select(KEY, F.lit(True).alias("_held")), [KEY], "left")
    part = F.when(F.col("_held"), F.when(F.col("i") == F.col("n") - HORIZONS - 1, "val")).otherwise("train")
    return marked.withColumn("part", part).drop("_held").filter("part is not null")


def last_windows(w: DataFrame, k: int = 1) -> DataFrame:
    """The last k windows of every region are 'val'."""
    return w.withColumn("part", F.when(F.col("i") >= F.col("n") - HORIZONS - k, "val").otherwise("train"))


def temporal_safe(w: DataFrame) -> DataFrame:
    """Training windows whose targets end before the validation targets begin; regions of 11 rows or more."""
    part = F.when(F.col("i") == F.col("n") - 6, "val").when(F.col("i") < F.col("n") - 10, "train")
    return w.filter("n >= 11").withColumn("part", part).filter("part is not null")


def common_cutoff(w: DataFrame, weeks: int) -> DataFrame:
    """'val' is each region's last window at or before one cutoff for all, 'train' those before it."""
    top = w.agg(F.max("last").alias("_top")) if "last" in w.columns else None
    marked = w.join(F.broadcast(top)) if top is not None else w
    cut = F.col("_top") - weeks * 7
    val = F.max(F.when(F.col(ORDER) <= cut, F.col("i"))).over(Window.partitionBy(KEY))
    part = F.when(F.col("i") == F.col("_val"), "val").when(F.col("i") < F.col("_val"), "train")
    return marked.withColumn("_val", val).filter("n >= 7 and _val >= 1").withColumn("part", part).filter("part is not null").drop("_val", "_top")


def last_weeks(w: DataFrame, weeks: int = 10) -> DataFrame:
    """The windows of the last weeks are 'val'; training stops four windows before."""
    begin = F.col("n") - weeks
    part = F.when(F.col("i") >= begin, "val").when(F.col("i") < begin - 4, "train")
    return w.filter(F.col("n") >= weeks + 6).withColumn("part", part).filter("part is not null")


def rolling_folds(w: DataFrame, folds: int = 5, step: int = 5, least: int = 30) -> DataFrame:
    """For each fold, one validation window and the windows whose targets end before its own; adds fold and part."""
    each = w.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    val = F.col("n") - F.col("fold") * step - 6
    part = F.when(F.col("i") == val, "val").when(F.col("i") < val - HORIZONS, "train")
    return each.filter(F.col("n") >= F.col("fold") * step + least).withColumn("part", part).filter("part is not null")


def offset_folds(w: DataFrame, offsets: Sequence[int] = (0, 5, 10)) -> DataFrame:
    each = w.withColumn("fold", F.explode(F.array(*map(F.lit, offsets))))
    val = F.col("n") - 6 - F.col("fold")
    part = F.when(F.col("i") == val, "val").when(F.col("i") <= val - HORIZONS, "train")
    return each.filter(F.col("n") > 2 * HORIZONS + F.col("fold")).withColumn("part", part).filter("part is not null")


def kfold(df: DataFrame, keys: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    digest = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in keys), F.lit(str(seed))).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k))


def subsample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    digest = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in keys), F.lit(str(seed))).cast("binary"))
    return df.orderBy(digest, *keys).limit(n)


def split_check(weekly: DataFrame, held: DataFrame) -> DataFrame:
    """Mean scores of both sides, their difference, and a status by its size."""
    marked = weekly.join(held.select(KEY, F.lit(1).alias("_held")), [KEY], "left")
    means = marked.agg(F.avg(F.when(F.col("_held").isNull(), F.col("score"))).alias("train_mean"), F.avg(F.when(F.col("_held") == 1, F.col("score"))).alias("val_mean"))
    diff = F.abs(F.col("val_mean") - F.col("train_mean"))
    return means.withColumn("diff", diff).withColumn("status", F.when(F.col("diff") < 0.02, "good").when(F.col("diff") < 0.05, "check").otherwise("bad"))
