"""Blend weights by grid search: one aggregate over predictions x grid, the first minimum wins.

A grid has tens to hundreds of weight vectors, so the errors of all come from one pass over the predictions, as sums
that are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import clip_score
from .evaluation import absolute_error
from .quantiles import quantiles

Weights = tuple[float, ...]

# fixed values: the published steps of the four-model grid
FOUR_A = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
FOUR_B = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
FOUR_C = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)


def grid(models: int) -> list[Weights]:
    """Steps of 0.05 (fixed values); the last weight is the rest, 0.05 at least."""
    steps = [round(x * 0.05, 2) for x in range(1, 20)]
    if models == 2:
        return [(a, round(1 - a, 8)) for a in steps]
    return [(a, b, round(1 - a - b, 8)) for a in steps for b in steps if round(1 - a - b, 8) >= 0.05]


def grid_four() -> list[Weights]:
    """The last weight is the rest, 0.05 at least."""
    out = [(a, b, c, round(1.0 - a - b - c, 8)) for a in FOUR_A for b in FOUR_B for c in FOUR_C]
    return [w for w in out if w[3] >= 0.05]


def grid_tenths() -> list[Weights]:
    tenths = [round(x / 10, 1) for x in range(1, 10)]
    return [(a, b, round(1.0 - a - b, 8)) for a in tenths for b in tenths if round(1.0 - a - b, 8) >= 0]


def grid_line() -> list[Weights]:
    return [(round(x / 100, 2), round(1 - x / 100, 2)) for x in range(101)]


def mix(weights: Sequence[float | Column], models: Sequence[str]) -> Column:
    terms = [(w if isinstance(w, Column) else F.lit(w)) * F.col(m) for w, m in zip(weights, models, strict=True)]
    return sum(terms[1:], terms[0])


def errors(p: DataFrame, models: Sequence[str], weights: list[Weights]) -> DataFrame:
    """nth, w1.. and mae of every weight vector."""
    rows = [F.struct(F.lit(i).cast("long").alias("nth"), *(F.lit(x).alias(f"w{j + 1}") for j, x in enumerate(w))) for i, w in enumerate(weights)]
    each = p.select("y", *models, F.explode(F.array(*rows)).alias("_w")).select("y", *models, "_w.*")
    names = [f"w{j + 1}" for j in range(len(models))]
    return each.groupBy("nth", *names).agg(F.avg(absolute_error(mix([F.col(n) for n in names], models), F.col("y"))).alias("mae"))


def best(p: DataFrame, models: Sequence[str], weights: list[Weights]) -> DataFrame:
    """The weights of the least mae; of equal ones (to 12 places) the first of the grid."""
    e = errors(p, models, weights)
    return e.orderBy(F.round("mae", 12), "nth").limit(1).drop("nth")


def with_persistence(model: Column, last: Column, share: float = 0.65) -> Column:
    return share * model + (1 - share) * last


def gate(p: DataFrame, model: str, chance: str) -> DataFrame:
    """The best a of (a * P(score > 0) + 1 - a) * prediction, a = 0, 0.05, ..., 1; ties go to the smaller a."""
    steps = [round(x * 0.05, 2) for x in range(21)]
    each = p.select("y", model, chance, F.explode(F.array(*map(F.lit, steps))).alias("alpha"))
    gated = (F.col("alpha") * F.col(chance) + (1 - F.col("alpha"))) * F.col(model)
    return each.groupBy("alpha").agg(F.avg(absolute_error(gated, F.col("y"))).alias("mae")).orderBy(F.round("mae", 12), "alpha").limit(1)


def median_shift(p: DataFrame, least: float = 0.02) -> DataFrame:
    """shift (0 unless medians differ by more than `least` and shifting lowers the error), mae_before and mae_after."""
    middle = quantiles(p, {c: (c, 0.5) for c in ("y", "pred")})
    shift = F.lit(None if None in middle.values() else middle["y"] - middle["pred"]).cast("double")
    moved = p.withColumn("_shift", shift).agg(F.first("_shift").alias("_shift"), F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae_before"), F.avg(F.abs(clip_score(F.col("pred") + F.col("_shift")) - F.col("y"))).alias("_moved"))
    used = (F.abs("_shift") > least) & (F.col("_moved") < F.col("mae_before"))
    return moved.select(F.when(used, F.col("_shift")).otherwise(F.lit(0.0)).alias("shift"), "mae_before", F.when(used, F.col("_moved")).otherwise(F.col("mae_before")).alias("mae_after"))


def rounding(p: DataFrame) -> DataFrame:
    """Whether rounding to integers, half to even, lowers the error."""
    m = p.agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae_plain"), F.avg(F.abs(F.rint("pred") - F.col("y"))).alias("mae_rounded"))
    return m.withColumn("use_rounded", F.col("mae_rounded") < F.col("mae_plain"))


def guarded(weighted: float, plain: float, slack: float = 0.008) -> bool:
    """Keep the weighted models unless they are worse by more than the slack."""
    return weighted <= plain + slack
