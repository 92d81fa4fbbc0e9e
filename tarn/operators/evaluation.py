"""Errors of forecasts, in long form: one row for each window and horizon, with y and pred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import band, clip_score, correlation, ratio
from .quantiles import quantiles

KEY = "region_id"
#: Ranges of scores in which ranks are counted.
RANGES = 256


def long_form(w: DataFrame, preds: dict[str, Sequence[str]] | None = None, horizons: int = 5, keep: Sequence[str] = (KEY, "i")) -> DataFrame:
    """horizon, y and, for each name in `preds`, its horizon's column."""
    rows = [F.struct(F.lit(k).cast("long").alias("horizon"), F.col(f"y{k}").alias("y"), *(F.col(cols[k - 1]).alias(n) for n, cols in (preds or {}).items())) for k in range(1, horizons + 1)]
    return w.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def absolute_error(pred: Column, y: Column) -> Column:
    return F.abs(clip_score(pred) - y)


def mae(p: DataFrame) -> DataFrame:
    return p.agg(F.avg(absolute_error(F.col("pred"), F.col("y"))).alias("mae"))


def by_horizon(p: DataFrame) -> DataFrame:
    """mae, bias and correlation (0 where either side hardly varies)."""
    flat = (F.stddev_pop("y") < 1e-6) | (F.stddev_pop("pred") < 1e-6)
    return p.groupBy("horizon").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"), F.avg(F.col("pred") - F.col("y")).alias("bias"), F.when(flat, F.lit(0.0)).otherwise(correlation(F.col("y"), F.col("pred"))).alias("corr"))


def by_band(p: DataFrame) -> DataFrame:
    """n, mae and its difference to the mae of all, by band of the true score."""
    error = F.abs(F.col("pred") - F.col("y"))
    each = p.groupBy(band(F.col("y")).alias("band")).agg(F.count("*").alias("n"), F.avg(error).alias("mae"))
    return each.join(F.broadcast(p.agg(F.avg(error).alias("_all")))).select("band", "n", "mae", (F.col("mae") - F.col("_all")).alias("delta"))


def variation_over_weeks(p: DataFrame) -> DataFrame:
    """Mean over windows of the population variance over horizons."""
    return p.groupBy(KEY, "i").agg(F.var_pop("pred").alias("_v")).agg(F.avg("_v").alias("variance"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by mean ranks of ties, from counts by score: one row for each distinct score.

    Ranks go by some 256 ranges of scores, then inside a range, so no task ranks all scores. NaN if all labels are equal.
    """
    at = df.groupBy(score).agg(F.sum(label).cast("double").alias("pos"), F.count("*").cast("double").alias("all"))
    bounds = df.agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)], 4 * RANGES)).first()[0] or []
    placed = at.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, dict.fromkeys(bounds))), lambda b: b < F.col(score))) if bounds else F.lit(0))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offset = placed.groupBy("_range").agg(F.sum("all").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_offset"))
    before = F.sum("all").over(Window.partitionBy("_range").orderBy(score)) - F.col("all") + F.col("_offset")
    ranked = placed.join(F.broadcast(offset), ["_range"]).withColumn("rank", before + (F.col("all") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("all").alias("n"))
    return total.select(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def encode_medians(train: DataFrame, to: DataFrame, horizons: int = 5) -> DataFrame:
    """Adds to `to` the median target of the region in `train` for each horizon; the median of all for unseen regions."""
    ys = range(1, horizons + 1)
    own = train.groupBy(KEY).agg(*(F.median(f"y{k}").alias(f"_own{k}") for k in ys))
    whole = quantiles(train, {f"y{k}": (f"y{k}", 0.5) for k in ys})
    joined = to.join(own, [KEY], "left")
    return joined.select(*to.columns, *(F.coalesce(f"_own{k}", F.lit(whole[f"y{k}"]).cast("double")).alias(f"region_median_week{k}") for k in ys))


def forecast_table(template: DataFrame, forecasts: DataFrame, horizons: int = 5) -> DataFrame:
    """One row for each region of the template: pred_week1..; clipped, 0 where there is no forecast."""
    cols = [f"pred_week{k}" for k in range(1, horizons + 1)]
    return template.select(KEY).join(forecasts.select(KEY, *cols), [KEY], "left").select(KEY, *(F.coalesce(clip_score(F.col(c)), F.lit(0.0)).alias(c) for c in cols))


def forecast_difference(a: DataFrame, b: DataFrame, horizons: int = 5) -> DataFrame:
    """Mean absolute difference and correlation of two forecasts by horizon; the latter NaN where one never varies."""
    cols = range(1, horizons + 1)
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{KEY}") == F.col(f"b.{KEY}"))
    pairs = both.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("horizon"), F.col(f"a.pred_week{k}").alias("x"), F.col(f"b.pred_week{k}").alias("y")) for k in cols))).alias("r")).select("r.*")
    return pairs.groupBy("horizon").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"), correlation(F.col("x"), F.col("y")).alias("corr"))
