"""Queries of trained models: they have no SQL form and are checked by their properties."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blending, climatology, models, splits, summaries, tuning, weekly
from ..operators.boosting import PUBLISHED, Params
from ..operators.evaluation import absolute_error
from ..operators.features import FULL, ensure_features
from ..sources.adapter import panel
from ..sources.shared import cut
from .base import query, window_rows

R = "region_id"
NAMES = ("prec", "tmp", "humidity", "wind", "score")
PREDICTED = [f"pred_week{k}" for k in range(1, 6)]


def _few(family: str, trees: int = 6, **more) -> Params:
    """A family's published settings with fewer, larger steps."""
    return replace(PUBLISHED[family], trees=trees, rate=0.2, bins=63, leaves=15, **more)


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = cut(splits.temporal_safe(window_rows(s, d)))
    return w.filter("part = 'train'"), w.filter("part = 'val'")


def full_rows(s: SparkSession, d: str) -> DataFrame:
    """Windows of weekly rows with all features of the full set; columns that the panel lacks are 0."""
    days = weekly.labelled(FULL.daily(panel(s, d)))
    weeks = cut(weekly.to_weekly(days))
    named = climatology.seasonal_mean(weeks, weeks).join(climatology.means(weeks, [R], to="regional_mean_score"), [R], "left")
    named = climatology.spi(climatology.seasonal_forward(named, weeks), climatology.spi_statistics(weeks))
    return cut(splits.temporal_safe(splits.windows(ensure_features(named, FULL.names))))


def _full_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = full_rows(s, d)
    return w.filter("part = 'train'"), w.filter("part = 'val'")


def _stopped(fit_on: DataFrame, val: DataFrame) -> DataFrame:
    return fit_on.withColumn("held", F.lit(False)).unionByName(val.withColumn("held", F.lit(True)))


def _lgb(s: SparkSession, d: str) -> DataFrame:
    """All features and the region as a category, weighted, stopped early by the validation part."""
    fit_on, val = _full_parts(s, d)
    return models.train(_stopped(fit_on, val), FULL.names, _few("lgb"), weights="band", held="held").predict(val).select(R, *PREDICTED)


def _xgb(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _full_parts(s, d)
    return models.train(_stopped(fit_on, val), FULL.names, _few("xgb"), weights="band", held="held").predict(val).select(R, *PREDICTED)


def _cat(s: SparkSession, d: str) -> DataFrame:
    """All features and the region's ordered mean target."""
    fit_on, val = models.with_region_target(*_full_parts(s, d))
    return models.train(_stopped(fit_on, val), [*FULL.names, "region_target"], _few("cat"), weights="band", held="held").predict(val).select(R, *PREDICTED)


def _l1(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _parts(s, d)
    return models.train(fit_on, NAMES, _few("l1"), weights="linear").predict(val).select(R, *PREDICTED)


def _extra(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _full_parts(s, d)
    return models.train_random(fit_on, FULL.names, replace(models.FOREST, trees=10, depth=8, least_rows=5)).predict(val).select(R, *PREDICTED)


query("gbt_lgb", None, _lgb)
query("gbt_xgb", None, _xgb)
query("gbt_cat", None, _cat)
query("gbt_l1", None, _l1)
query("extra_trees", None, _extra)


def _seeds(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _parts(s, d)
    return models.predict_mean(models.train_seeds(fit_on, NAMES, _few("lgb"), (42, 123, 777)), val).select(R, *PREDICTED)


query("multi_seed_models", None, _seeds)


def _best(s: SparkSession, d: str) -> DataFrame:
    """The mean best number of trees over three seeds, for each horizon."""
    found = models.train_seeds(_stopped(*_parts(s, d)), NAMES, _few("lgb", 12, patience=3), held="held")
    return s.createDataFrame(list(enumerate(models.best_counts(found), 1)), "horizon long, trees long")


def _schedule(s: SparkSession, d: str) -> DataFrame:
    seeds = (42, 123)
    found = models.train_following(_stopped(*_parts(s, d)), NAMES, _few("lgb", 12, patience=3), seeds, "held")
    return s.createDataFrame([(seed, k, n) for seed, m in zip(seeds, found, strict=True) for k, n in enumerate(m.tree_counts, 1)], "seed long, horizon long, trees long")


query("best_iter", None, _best)
query("seed_schedule", None, _schedule)


def _chain(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _parts(s, d)
    return models.predict_chain(models.train_chain(fit_on, NAMES, _few("lgb")), val).select(R, *PREDICTED)


query("chain", None, _chain)


def _hurdle(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _parts(s, d)
    return models.predict_hurdle(models.train_hurdle(fit_on, NAMES), NAMES, val).select(R, *(f"chance{k}" for k in range(1, 6)))


query("clf_hurdle", None, _hurdle)


def _drift(s: SparkSession, d: str) -> DataFrame:
    days = weekly.hide_last(panel(s, d))
    score = models.drift(days.filter("split = 'train'"), days.filter("split = 'test'"), ("prec", "tmp", "humidity", "wind"))
    return s.createDataFrame([(score, score > 0.65)], "auc double, drift boolean")


query("clf_drift", None, _drift)


def _groups(s: SparkSession, d: str) -> DataFrame:
    fit_on, _ = _parts(s, d)
    return models.importance_by_group(models.train(fit_on, NAMES, _few("lgb")).importances(s), 3)


query("importance_groups", None, _groups)


def _importance(s: SparkSession, d: str) -> DataFrame:
    fit_on, _ = _parts(s, d)
    return summaries.cumulative_share(models.train(fit_on, NAMES, _few("lgb")).importances(s))


query("rank_importance", None, _importance)
query("feat_select", None, lambda s, d: s.createDataFrame([(n,) for n in models.select_features(_importance(s, d).select("feature", "gain"), 3)], "feature string"))


def _permutation(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _parts(s, d)
    return s.createDataFrame(models.permutation_importance(models.train(fit_on, NAMES, _few("lgb")), val, NAMES), "feature string, growth double")


query("perm_importance", None, _permutation)


def _tune(s: SparkSession, d: str) -> DataFrame:
    best, _ = tuning.tune(_stopped(*_parts(s, d)), NAMES, "y1", "held", replace(_few("l1", 8), patience=4), trials=12, batch=6, category=R)
    return s.createDataFrame([(k, float(v)) for k, v in best.items()], "parameter string, value double")


query("tune", None, _tune)


def _guard(s: SparkSession, d: str) -> DataFrame:
    fit_on, val = _parts(s, d)
    errors = [models.train(fit_on, NAMES, _few("lgb"), weights=w).predict(val).agg(F.avg(absolute_error(F.col("pred_week1"), F.col("y1")))).first()[0] for w in ("band", None)]
    return s.createDataFrame([(*errors, blending.guarded(*errors))], "mae_weighted double, mae_plain double, use_weighted boolean")


query("weights_guard", None, _guard)


def _top(s: SparkSession, d: str) -> DataFrame:
    fit_on, _ = _full_parts(s, d)
    return models.top_features(models.train(fit_on, FULL.names, _few("lgb", 3)).importances(s))


query("top_features", None, _top)
