"""Tree ensembles for each horizon: boosted families and random trees on histograms; classifiers on pyspark.ml.

The five horizons, and all seeds, are trained in one call over the same binned rows. Predictions are held to [0, 5].
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import band_weight, clip_score, linear_weight
from .boosting import PUBLISHED, Boosted, Job, Params, ordered_target_mean, train_jobs
from .evaluation import absolute_error
from .features import WEATHER
from .forest import train_forest
from .splits import HORIZONS, YS


def imputed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Nulls become 0, and <name>_missing tells them apart."""
    return df.withColumns({f"{n}_missing": F.col(n).isNull().cast("double") for n in names} | {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


def _inputs(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[*names, *(f"{n}_missing" for n in names)], outputCol="features")


#: Families of the boosted models, as published; `forest` are random trees.
FAMILIES: dict[str, Params] = PUBLISHED
# fixed values: the published settings of the random trees
FOREST = Params(trees=300, depth=20, least_rows=50, columns=0.7)
KEY = "region_id"


@dataclass
class Horizons:
    """One model for each horizon: the jobs of a boosted call from `first` on, `each` of them for a horizon."""

    boosted: Boosted
    first: int = 0
    each: int = 1

    @property
    def names(self) -> list[str]:
        return self.boosted.names

    def jobs(self, k: int) -> list[int]:
        """Jobs of a horizon, from 1."""
        begin = self.first + (k - 1) * self.each
        return list(range(begin, begin + self.each))

    def predict(self, df: DataFrame, prefix: str = "pred_week") -> DataFrame:
        return _mean_of([self], self.boosted.predict(df, "_predictions"), df.columns, prefix)

    @property
    def tree_counts(self) -> list[int]:
        return [len(self.boosted.trees[self.jobs(k)[0]]) for k in range(1, HORIZONS + 1)]

    def importances(self, spark) -> DataFrame:
        """feature and mean gain over the horizons."""
        own = [j for k in range(1, HORIZONS + 1) for j in self.jobs(k)]
        gains = self.boosted.importances()[own].sum(axis=0) / HORIZONS
        return spark.createDataFrame([(n, float(g)) for n, g in zip(self.names, gains, strict=True)], "feature string, gain double")


def _mean_of(models: Sequence[Horizons], predicted: DataFrame, keep: Sequence[str], prefix: str) -> DataFrame:
    """The mean of the models' predictions, held to [0, 5]."""
    parts = lambda k: [F.col("_predictions")[j] for m in models for j in m.jobs(k)]
    mean = lambda k: clip_score(sum(parts(k)[1:], parts(k)[0]) / len(parts(k)))
    return predicted.select(*(f"`{c}`" for c in keep), *(mean(k).alias(f"{prefix}{k}") for k in range(1, HORIZONS + 1)))


#: Weights of a row by its target.
WEIGHTS: dict[str, Callable[[Column], Column]] = {"band": band_weight, "linear": linear_weight}


def train(df: DataFrame, names: Sequence[str], family: str | Params = "lgb", seed: int = 42, weights: str | None = None, held: str | None = None, trees: Sequence[int] | None = None) -> Horizons:
    """One boosted model for each horizon; those that take a category get the region.

    `held` names a boolean column: boosting stops where the error on its rows falls no more, and keeps the trees up to the
    best. `trees` sets the number of trees for each horizon instead.
    """
    return train_seeds(df, names, family, [seed], held, weights, trees)[0]


def train_seeds(
    df: DataFrame, names: Sequence[str], family: str | Params = "lgb", seeds: Sequence[int] = (42, 123, 777), held: str | None = None, weights: str | None = None, trees: Sequence[int] | None = None
) -> list[Horizons]:
    """Models of several seeds in one call, so rows are binned once; with `held` each of them stops early."""
    p = FAMILIES[family] if isinstance(family, str) else family
    counts = trees or [p.trees] * HORIZONS
    jobs = [Job(k, seed + k, replace(p, trees=counts[k])) for seed in seeds for k in range(HORIZONS)]
    rows = df.withColumns({f"_weight{k}": WEIGHTS[weights](F.col(y)) for k, y in enumerate(YS)}) if weights else df
    boosted = train_jobs(rows, names, YS, jobs, KEY if p.category else None, [f"_weight{k}" for k in range(HORIZONS)] if weights else None, held)
    return [Horizons(boosted, i * HORIZONS) for i in range(len(seeds))]


def train_following(df: DataFrame, names: Sequence[str], family: str | Params = "lgb", seeds: Sequence[int] = (42, 123), held: str | None = None) -> list[Horizons]:
    """The first seed stops early, the others take its numbers of trees."""
    first = train(df, names, family, seeds[0], held=held)
    fit_on = df.filter(~F.col(held)) if held else df
    return [first, *train_seeds(fit_on, names, family, seeds[1:], trees=first.tree_counts)]


def train_random(df: DataFrame, names: Sequence[str], p: Params = FOREST, seed: int = 42, weights: str | None = None) -> Horizons:
    """Random trees for each horizon."""
    rows = df.withColumns({f"_weight{k}": WEIGHTS[weights](F.col(y)) for k, y in enumerate(YS)}) if weights else df
    return Horizons(train_forest(rows, names, YS, p.trees, p, seed, [f"_weight{k}" for k in range(HORIZONS)] if weights else None), 0, p.trees)


def with_region_target(fit_on: DataFrame, others: DataFrame, target: str = "y1", order: Sequence[str] = ("i",), seed: int = 42, to: str = "region_target") -> tuple[DataFrame, DataFrame]:
    """Both tables with the region's mean target: of earlier rows in a fixed random order for training rows, of all training rows for others."""
    prior = float(fit_on.agg(F.avg(target)).first()[0] or 0.0)
    means = fit_on.groupBy(F.col(KEY).alias("_region")).agg(((F.coalesce(F.sum(target), F.lit(0.0)) + prior) / (F.count(target) + 1)).alias("_mean"))
    joined = others.join(means, F.col(KEY).eqNullSafe(F.col("_region")), "left")
    return ordered_target_mean(fit_on, KEY, target, order, seed, prior, to=to), joined.select(*others.columns, F.coalesce("_mean", F.lit(prior)).alias(to))


def best_counts(models: Sequence[Horizons]) -> list[int]:
    """The rounded mean number of trees for each horizon, for a final fit on all rows."""
    return [max(1, round(sum(m.tree_counts[k] for m in models) / len(models))) for k in range(HORIZONS)]


# fixed values: groups of features by their names; a name may be in several
GROUPS: dict[str, str] = {
    "rolling": "^(?!.*(surf_pre|dp_tmp)).*roll",
    "rolling_surf_pre": "surf_pre_roll",
    "rolling_dp_tmp": "dp_tmp_roll",
    "spi": "spi",
    "lags": "_lag",
    "drought": "deficit|trend|anomaly|drought|dry_days",
    "weather": "^(" + "|".join(WEATHER) + ")$",
    "seasonal": "seasonal|rsm_fw",
    "regional_mean": "^regional_mean_score$",
}


def importance_by_group(importances: DataFrame, top: int = 10) -> DataFrame:
    """part and its share of all gain, in percent: every group of names, and the `top` features together."""
    ranked = importances.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("gain"), "feature")))  # a row for each feature
    every = F.sum("gain")
    share = lambda ok: F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("gain"))), every) * 100, F.lit(0.0))
    one = ranked.agg(*(share(F.regexp_like("feature", F.lit(p))).alias(g) for g, p in GROUPS.items()), share(F.col("_place") <= top).alias(f"top{top}"))
    return one.unpivot([], one.columns, "part", "percent")


def predict_mean(models: Sequence[Horizons], df: DataFrame) -> DataFrame:
    """Mean prediction over seeds, in one pass for those that were trained together."""
    together: dict[int, list[Horizons]] = {}
    for m in models:
        together.setdefault(id(m.boosted), []).append(m)
    out, ks = df, range(1, HORIZONS + 1)
    for g, own in enumerate(together.values()):
        out = _mean_of(own, own[0].boosted.predict(out, "_predictions"), out.columns, f"_group{g}_")
    share = [len(own) / len(models) for own in together.values()]
    mean = lambda k: sum((F.col(f"_group{g}_{k}") * s for g, s in enumerate(share)), F.lit(0.0))
    return out.select(*(f"`{c}`" for c in df.columns), *(mean(k).alias(f"pred_week{k}") for k in ks))


def train_chain(df: DataFrame, names: Sequence[str], family: str | Params = "lgb", seed: int = 42) -> list[Boosted]:
    """Horizon k also sees the true y1..y(k-1)."""
    p = FAMILIES[family] if isinstance(family, str) else family
    seen = df.withColumns({f"_{y}": F.col(y) for y in YS})
    return [train_jobs(seen, [*names, *(f"_{y}" for y in YS[:k])], [YS[k]], [Job(0, seed, p)], KEY if p.category else None) for k in range(HORIZONS)]


def predict_chain(models: Sequence[Boosted], df: DataFrame) -> DataFrame:
    """Horizon k sees the predictions before it."""
    out = df
    for y, m in zip(YS, models, strict=False):
        out = m.predict(out, "_predictions").withColumn(f"_{y}", clip_score(F.col("_predictions")[0])).drop("_predictions")
    return out.select(*df.columns, *(F.col(f"_{y}").alias(f"pred_week{k}") for k, y in enumerate(YS[: len(models)], 1)))


def train_hurdle(df: DataFrame, names: Sequence[str], seed: int = 42) -> list[PipelineModel]:
    """P(score > 0) for each horizon."""
    ready = imputed(df, names)
    out = []
    for k in range(1, HORIZONS + 1):
        tree = GBTClassifier(maxIter=10, maxDepth=3, seed=seed, labelCol="_label", featuresCol="features")
        out.append(Pipeline(stages=[_inputs(names), tree]).fit(ready.withColumn("_label", (F.col(f"y{k}") > 0).cast("double"))))
    return out


def predict_hurdle(models: Sequence[PipelineModel], names: Sequence[str], df: DataFrame) -> DataFrame:
    out = imputed(df, names)
    for k, m in enumerate(models, 1):
        out = m.transform(out).withColumn(f"chance{k}", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability", "features")
    return out.select(*df.columns, *(f"chance{k}" for k in range(1, len(models) + 1)))


def drift(train_rows: DataFrame, test_rows: DataFrame, names: Sequence[str], folds: int = 3, seed: int = 42) -> float:
    """Mean AUC over folds of telling test rows from training rows; above 0.65 the two differ."""
    both = imputed(train_rows.select(*names).withColumn("label", F.lit(0.0)).union(test_rows.select(*names).withColumn("label", F.lit(1.0))), names)
    parts = both.randomSplit([1.0] * folds, seed)
    found = []
    for i in range(folds):
        rest = [p for j, p in enumerate(parts) if j != i]
        fit_on = rest[0]
        for p in rest[1:]:
            fit_on = fit_on.union(p)
        model = Pipeline(stages=[_inputs(names), GBTClassifier(maxIter=5, maxDepth=3, seed=seed, labelCol="label")]).fit(fit_on)
        found.append(BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(parts[i])))
    return sum(found) / folds


def select_features(importances: DataFrame, k: int) -> list[str]:
    return [r["feature"] for r in importances.orderBy(F.desc("gain"), "feature").limit(k).collect()]


def permutation_importance(model: Horizons, rows: DataFrame, names: Sequence[str]) -> list[tuple[str, float]]:
    """Growth of the first horizon's mean error with a feature set to its mean, all features in one job."""
    means = rows.agg(*(F.avg(n).alias(n) for n in names)).first()
    each = rows.withColumn("_constant", F.explode(F.array(*map(F.lit, range(-1, len(names))))))
    flat = each.withColumns({n: F.when(F.col("_constant") == i, F.lit(means[n]).cast("double")).otherwise(F.col(n)) for i, n in enumerate(names)})
    found = model.predict(flat).groupBy("_constant").agg(F.avg(absolute_error(F.col("pred_week1"), F.col("y1"))).alias("error")).collect()
    error = {r["_constant"]: r["error"] for r in found}
    return [(n, error[i] - error[-1]) for i, n in enumerate(names)] if error else []


#: Tags of features in the list of the most important ones, the first that fits.
TAGS = {"SPI": "spi", "NEW": "surf_pre_roll|dp_tmp_roll", "FW": "^rsm_fw"}  # fixed values


def top_features(importances: DataFrame, top: int = 25) -> DataFrame:
    """place, feature, its share of all gain in percent, and its tag."""
    whole = importances.agg(F.sum("gain").alias("_whole"))
    tag = F.coalesce(*(F.when(F.regexp_like("feature", F.lit(p)), F.lit(t)) for t, p in TAGS.items()), F.lit(""))
    place = F.row_number().over(Window.orderBy(F.desc("gain"), "feature"))  # a row for each feature
    ranked = importances.crossJoin(F.broadcast(whole)).select(place.alias("place"), "feature", F.coalesce(F.try_divide(F.col("gain") * 100, "_whole"), F.lit(0.0)).alias("percent"), tag.alias("tag"))
    return ranked.filter(F.col("place") <= top)
