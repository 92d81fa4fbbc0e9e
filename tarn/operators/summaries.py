"""Summaries of panels: profiles, gaps, correlations and contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import correlation, ratio
from .quantiles import quantiles
from .rolling import by_time, roll

KEY, ORDER = "region_id", "ordinal"


def region_summary(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    return panel.groupBy(KEY).agg(
        F.count("*").alias("n_rows"), F.count("score").alias("n_scored"), (F.count("score") / F.count("*")).alias("score_rate"), F.avg("score").alias("score_mean"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        *(F.avg(c).alias(f"{c}_mean") for c in columns),
    )


def region_partial(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, sums and bounds of one part of a panel by region, for `merge_partials`."""
    sums = [f(F.col(x)).alias(f"{x}_{n}") for x in ("score", *columns) for f, n in ((F.sum, "sum"), (F.count, "count"))]
    return panel.groupBy(KEY).agg(F.count("*").alias("n_rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), *sums)


def merge_partials(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """The region summary of all parts together; a region may be in any of them."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n_rows, scored = F.sum("n_rows"), F.sum("score_count")
    mean = lambda x: F.try_divide(F.sum(f"{x}_sum"), F.sum(f"{x}_count"))
    return every.groupBy(KEY).agg(
        n_rows.alias("n_rows"), scored.alias("n_scored"), (scored / n_rows).alias("score_rate"), mean("score").alias("score_mean"), F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        *(mean(x).alias(f"{x}_mean") for x in columns),
    )


def table_summary(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, labelled rows, first and last day and nulls of each column: one pass, combined before the shuffle."""
    return panel.agg(F.count("*").alias("n_rows"), F.count("score").alias("n_scored"), F.min(ORDER).alias("first_ordinal"), F.max(ORDER).alias("last_ordinal"), *((F.count("*") - F.count(c)).alias(f"{c}_nulls") for c in columns))


def score_description(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.max("score").alias("max"), F.count("score").alias("count"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nulls and percent."""
    one = df.agg(F.count("*").alias("_n"), *((F.count("*") - F.count(c)).alias(c) for c in columns))
    return one.unpivot(["_n"], list(columns), "column", "nulls").select("column", "nulls", (F.col("nulls") * 100.0 / F.col("_n")).alias("percent"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, std, min, quartiles and max."""
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = quantiles(df, {f"{c}_{q}": (c, s) for c in columns for q, s in shares.items()})
    parts = [
        F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *(F.lit(found[f"{c}_{q}"]).cast("double").alias(q) for q in shares), F.max(c).alias("max"))
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b and corr of all pairs, in one aggregate; corr is NaN where a column never varies."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def correlations_with(df: DataFrame, columns: Sequence[str], target: str = "score") -> DataFrame:
    """column and corr with the target; NaN where either never varies."""
    parts = [F.struct(F.lit(c).alias("column"), correlation(F.col(c), F.col(target)).alias("corr")) for c in columns]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def lagged(panel: DataFrame, columns: Sequence[str], steps: Sequence[int]) -> DataFrame:
    return panel.select("score", *(F.lag(c, k).over(by_time()).alias(f"{c}_lag{k}") for c in columns for k in steps))


def rolled_now(panel: DataFrame, columns: Sequence[str], width: int = 7) -> DataFrame:
    """Mean and deviation of the last days with the current one."""
    return panel.select("score", *(roll(c, s, 1 - width, 0, 1).alias(f"{c}_now{width}_{s}") for c in columns for s in ("mean", "std")))


def extreme_contrast(panel: DataFrame, columns: Sequence[str], share: float = 0.95) -> DataFrame:
    """Mean score and rows above a column's quantile and elsewhere, over labelled rows."""
    rows = panel.filter(F.col("score").isNotNull())
    edges = quantiles(rows, {c: (c, share) for c in columns})
    high = lambda c: F.col(c) > F.lit(edges[c])
    parts = [F.struct(F.lit(c).alias("column"), F.avg(F.when(high(c), F.col("score"))).alias("mean_high"), F.avg(F.when(~high(c), F.col("score"))).alias("mean_rest"), F.sum(high(c).cast("long")).alias("n_high"), F.sum((~high(c)).cast("long")).alias("n_rest")) for c in columns]
    return rows.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def range_compare(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column with least and largest values of both sides of `split`."""
    side = lambda c, s: F.when(F.col("split") == s, F.col(c))
    parts = [F.struct(F.lit(c).alias("column"), *(f(side(c, s)).alias(f"{s}_{n}") for s in ("train", "test") for n, f in (("min", F.min), ("max", F.max)))) for c in columns]
    return df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_c")).select("_c.*")


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """Number, largest and mean of steps of more than one ordinal, by region."""
    step = F.col(ORDER) - F.lag(ORDER, 1).over(by_time())
    steps = panel.select(KEY, step.alias("step"))
    gap = F.when(F.col("step") > 1, F.col("step"))
    return steps.groupBy(KEY).agg(F.count(gap).alias("n_gaps"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"))


def label_gaps(panel: DataFrame) -> DataFrame:
    """How often labels are so many ordinals apart."""
    rows = panel.filter(F.col("score").isNotNull())
    step = F.col(ORDER) - F.lag(ORDER, 1).over(by_time())
    return rows.select(step.alias("step")).filter("step is not null").groupBy("step").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def consistency(panel: DataFrame, pressure: str | None = None) -> DataFrame:
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    checks = [bad(F.col("tmp_max") < F.col("tmp_min")).alias("max_below_min"), bad((F.col("tmp") < F.col("tmp_min")) | (F.col("tmp") > F.col("tmp_max"))).alias("tmp_outside")]
    return panel.agg(*checks, *([bad(F.col(pressure) < 80).alias("low_pressure")] if pressure else []))


def clip_to_quantiles(panel: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns held within their own quantiles, by region."""
    edges = panel.groupBy(KEY).agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in columns))
    held = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1])) for c in columns}
    return panel.join(edges, [KEY], "left").withColumns(held).select(*panel.columns)


def score_bands(panel: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Regions by band of their mean score: band b holds [edges[b], edges[b + 1])."""
    mean = panel.groupBy(KEY).agg(F.avg("score").alias("m")).filter("m is not null")
    band = sum(((F.col("m") >= e).cast("long") for e in edges[1:]), F.lit(0).cast("long"))
    return mean.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def first_regions(df: DataFrame, k: int) -> DataFrame:
    few = df.select(KEY).distinct().orderBy(KEY).limit(k)
    return df.join(F.broadcast(few), [KEY], "left_semi")


def top_by_size(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(F.abs(column)), "column").limit(k)


def extreme_keys(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row: the keys of the largest and the smallest value; of equal values the smallest key."""
    rows = df.filter(F.col(column).isNotNull())
    best = lambda sign: F.min(F.struct(sign * F.col(column), F.col(key)))[key]
    return rows.agg(best(-1).alias("high"), best(1).alias("low"))


def year_span(df: DataFrame) -> DataFrame:
    """Adds global_year_norm: the ordinal between the least and the largest of all rows."""
    span = df.agg(F.min(ORDER).alias("_a"), F.max(ORDER).alias("_b"))
    return df.join(F.broadcast(span)).select(*df.columns, ((F.col(ORDER) - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1))).alias("global_year_norm"))


def cumulative_share(importances: DataFrame) -> DataFrame:
    """feature, gain, share, place and cumulative share; shares are NaN if no feature has gained."""
    w = Window.orderBy(F.desc("gain"), "feature")
    total = F.sum("gain").over(Window.partitionBy())
    return importances.select("feature", "gain", ratio(F.col("gain"), total).alias("share"), F.row_number().over(w).cast("long").alias("place"), ratio(F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)), total).alias("cumulative"))
