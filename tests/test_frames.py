"""Running sums, doubling, chunks and exact quantiles against plain windows and sorted values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import evaluation, features, frames, quantiles, rolling

R = random.Random(9)


def panel(spark, regions=(700, 40, 1, 0), gaps=True):
    rows = []
    for r, n in enumerate(regions):
        day = 0
        for _ in range(n):
            day += R.choice([1, 1, 1, 2, 40]) if gaps else 1
            rows.append((None if r == 2 else f"R{r}", day, day % 12 + 1, day % 31 + 1, R.choice([None, *(round(R.uniform(0, 9), 2) for _ in range(9))]), float(R.randrange(4))))
    R.shuffle(rows)
    return spark.createDataFrame(rows, "region_id string, ordinal int, month int, day int, prec double, tmp double").repartition(3)


def assert_same(a, b):
    a, b = (d.toPandas().sort_values(["region_id", "ordinal"], ignore_index=True) for d in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == object:
            assert (a[c].fillna("") == b[c].fillna("")).all()
        else:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True), c


WANTED = [frames.Prior(c, s, w, least, f"{c}_{s}{w}") for c in ("prec", "tmp") for s in ("mean", "std", "max", "min", "sum", "median") for w, least in ((1, 1), (2, 1), (7, 3), (8, 3), (30, 3), (63, 6))]


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_priors_equal_frames(spark, chunk):
    df = panel(spark)
    plain = df.select("*", *(rolling.prior(p.column, p.stat, p.width, p.least).alias(p.name) for p in WANTED))
    assert_same(frames.over_chunks(df, 63, lambda d: frames.with_priors(d, WANTED), chunk), plain)


def test_one_long_region_spreads_over_tasks(spark):
    """Nine tenths of all rows are one region's: no key of the window has more than a chunk and what it reaches back to."""
    df = panel(spark, (9000, 1000), gaps=False)
    seen = []

    def build(d):
        seen.append(d.groupBy("region_id").count().agg(F.max("count"), F.count("*")).first())
        return frames.with_priors(d, [frames.Prior("tmp", "max", 180, 18, "x")])

    out = frames.over_chunks(df, 180, build, 500)
    assert out.count() == 10_000
    most, keys = seen[0]
    assert most <= 500 + 180 + 500 and keys >= 20


def test_feature_sets_do_not_depend_on_chunks(spark):
    df = panel(spark, (900, 30)).withColumns({c: F.col("tmp") + i for i, c in enumerate(("humidity", "wind", "surf_pre", "dp_tmp", "tmp_range", "tmp_max"))})
    few = features.FeatureSet(raw=(), roll_widths=(7, 180))
    assert_same(few.daily(df, 60), few.daily(df))
    assert set(few.names) - set(few.daily(df).columns) == {"regional_mean_score", "regional_seasonal_mean", *(f"rsm_fw_wk{k}" for k in range(1, 6)), *(f"{c}_spi{w}" for c, w in few.spi)}


@pytest.mark.parametrize("few", [100_000, 10])
def test_quantiles_equal_sorted_values(spark, few):
    x = [R.choice([None, R.gauss(0, 1), 1.0, 1.0, float(R.randrange(5))]) for _ in range(5000)]
    df = spark.createDataFrame([(v, 7.0, None, float(i)) for i, v in enumerate(x)], "x double, same double, none double, n double").repartition(3)
    wanted = {f"{c}{s}": (c, s) for c in ("x", "same", "none", "n") for s in (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)}
    got = quantiles.quantiles(df, wanted, few)
    for key, (c, s) in wanted.items():
        values = [v for v in {"x": x, "same": [7.0], "none": [], "n": list(range(5000))}[c] if v is not None]
        assert got[key] == (pytest.approx(np.quantile(values, s)) if values else None), key
    assert set(quantiles.quantiles(df.limit(0), wanted, few).values()) == {None}


def test_auc_by_ranges(spark):
    pairs = [(R.randrange(2), R.choice([0.5, R.random(), round(R.random(), 1)])) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "label int, score double")
    a, b = np.array([s for y, s in pairs if y]), np.array([s for y, s in pairs if not y])
    want = ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))
    assert evaluation.auc(df, "label", "score").first()[0] == pytest.approx(want)
