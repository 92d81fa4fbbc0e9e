"""Null rules, calendar, leakage and split invariants on hand-made rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import calendar as cal
from tarn.functions import measures as ms
from tarn.operators import blending, evaluation, features, models, rolling, sequences, splits, summaries, weekly
from tarn.sources import files


def series(spark, values, region="R1", start=742000, scores=None):
    rows = [(region, start + i, None if v is None else float(v), None if scores is None else scores[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region_id string, ordinal int, prec double, score double")


def column(df, name):
    return [r[name] for r in df.orderBy("region_id", "ordinal").collect()]


def test_years_beyond_dates(spark):
    df = spark.createDataFrame([("10004-12-31",), ("58061-01-02",), ("8133-12-31",), ("bad",), (None,)], "d string")
    got = df.select(cal.split_date(F.col("d")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(10004, 12, 31), (58061, 1, 2), (8133, 12, 31), (None, None, None), (None, None, None)]
    back = df.limit(3).select(cal.split_date(F.col("d")).alias("s")).select(cal.join_date(F.col("s.year"), F.col("s.month"), F.col("s.day")).alias("d")).collect()
    assert [r.d for r in back] == ["10004-12-31", "58061-01-02", "8133-12-31"]


def test_nan_is_null_and_clips_keep_null(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,)], "v string").select(ms.coerce(F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == [1.5, None, None, None]
    got = df.select(ms.at_least(F.col("x"), 2.0).alias("a"), ms.clip(F.col("x"), 0.0, 1.0).alias("b")).collect()
    assert [tuple(r) for r in got] == [(2.0, 1.0)] + [(None, None)] * 3


def test_one_row_region(spark):
    df = series(spark, [1.0])
    assert column(df.select("*", *rolling.lags(["prec"], [1]), rolling.prior("prec", "std", 7, 3).alias("s")), "s") == [None]
    assert splits.windows(df).count() == 0


@pytest.mark.parametrize(("n", "expected"), [(5, 0), (6, 1), (7, 2)])
def test_window_counts(spark, n, expected):
    assert splits.windows(series(spark, range(n), scores=[1.0] * n)).count() == expected


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=40))
def test_rolling_like_pandas(spark, values):
    df = series(spark, values)
    x = pd.Series([np.nan if v is None else v for v in values]).shift(1)
    r = x.rolling(7, min_periods=3)
    for stat, want in (("mean", r.mean()), ("max", r.max()), ("median", r.median())):
        got = column(df.select("*", rolling.prior("prec", stat, 7, 3).alias("x")), "x")
        np.testing.assert_allclose([np.nan if g is None else g for g in got], want, atol=1e-9)
    got = column(rolling.ewm_prior(df, "prec", 2, 3, "x"), "x")
    np.testing.assert_allclose([np.nan if g is None else g for g in got], x.ewm(span=2, min_periods=3).mean(), atol=1e-9)


def test_wide_and_long_means_like_pandas(spark):
    rng = np.random.default_rng(1)
    values = [None if 300 <= i < 900 or rng.random() < 0.1 else float(rng.normal(1000, 300)) for i in range(1499)]
    x = pd.Series([np.nan if v is None else v for v in values]).shift(1)
    for span in (14, 365):
        got = column(rolling.ewm_prior(series(spark, values), "prec", span, 3, "x"), "x")
        np.testing.assert_allclose([np.nan if g is None else g for g in got], x.ewm(span=span, min_periods=3).mean(), rtol=1e-9)


def test_first_row_counts_as_not_dry(spark):
    got = column(rolling.dry_days(series(spark, [0, 0, 5, 0])), "dry_days_14d")
    assert got == [None, None, 2.0, 2.0]


def test_constant_series_keeps_the_floor(spark):
    got = column(series(spark, [2.0] * 40).select("*", features.trend("prec").alias("x")), "x")
    assert got[-1] == 0.0


def test_prefix_sums_equal_frames(spark):
    rng = np.random.default_rng(1)
    df = series(spark, [None if x < 10 else 1e5 + x for x in rng.uniform(0, 100, 120)])
    a = rolling.prior_means_by_prefix(df, "prec", [7, 30])
    b = df.select("*", *(rolling.prior("prec", s, w, rolling.tenth(w)).alias(f"prec_roll{w}_{s}") for w in (7, 30) for s in ("mean", "std")))
    for c in ("prec_roll7_mean", "prec_roll7_std", "prec_roll30_mean", "prec_roll30_std"):
        x, y = ([np.nan if v is None else v for v in column(t, c)] for t in (a, b))
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-6)


def test_no_feature_sees_the_future(spark):
    rng = np.random.default_rng(2)
    values = rng.uniform(0, 10, 60)
    other = values.copy()
    other[40:] += 100
    fs = features.FeatureSet(raw=(), lag_columns=("prec",), roll_columns=("prec",), roll_widths=(7, 30), with_indices=False)
    a, b = (fs.daily(series(spark, v).withColumns({"month": F.lit(1), "day": F.lit(1)})).filter(F.col("ordinal") <= 742040).drop("prec") for v in (values, other))
    assert a.exceptAll(b).count() == 0 and a.count() == 41


def test_full_feature_names():
    weather = "prec surf_pre humidity tmp dp_tmp wb_tmp tmp_max tmp_min tmp_range surf_tmp wind wind_max wind_min wind_range".split()
    lagged = [f"{c}_lag{k}" for c in "tmp_range tmp_max tmp prec wind surf_pre humidity".split() for k in (1, 3, 7, 14, 21)]
    rolled = [f"{c}_roll{w}_{s}" for c in "prec humidity tmp wind surf_pre dp_tmp".split() for w in (7, 14, 30, 60, 90, 180) for s in ("mean", "std", "max")]
    rest = "month_sin month_cos day_sin day_cos prec_deficit_90d prec_trend_30d humidity_deficit_90d tmp_anomaly_90d heat_drought_idx dry_days_14d dry_days_30d regional_mean_score regional_seasonal_mean".split()
    rest += [f"rsm_fw_wk{k}" for k in range(1, 6)] + "prec_spi30 prec_spi90 prec_spi180 tmp_spi90".split()
    assert features.FULL.names == weather + lagged + rolled + rest
    assert len(features.FULL.names) == 179
    assert {k: len(v.names) for k, v in features.VERSIONS.items()} == {"v31": 179, "v30": 175, "v29": 139, "v27": 133, "v24": 134}


def test_safe_splits_share_no_targets(spark):
    w = splits.windows(series(spark, range(60), scores=[1.0] * 60))
    safe = {r.part: [x.i for x in splits.temporal_safe(w).filter(F.col("part") == r.part).collect()] for r in splits.temporal_safe(w).select("part").distinct().collect()}
    assert max(safe["train"]) + 5 < min(safe["val"]) + 1
    for r in splits.rolling_folds(w).groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("i"))).alias("t"), F.max(F.when(F.col("part") == "val", F.col("i"))).alias("v")).collect():
        assert r.t + 5 < r.v + 1


def test_quartile_ties(spark):
    means = [0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0]
    rows = [(f"R{i}", 1, m) for i, m in enumerate(means)]
    got = {r.region_id: r.quartile for r in splits.quartiles(spark.createDataFrame(rows, "region_id string, ordinal int, score double")).collect()}
    want = pd.qcut(pd.Series(means), 4, labels=False, duplicates="drop")
    assert [got[f"R{i}"] for i in range(8)] == want.tolist()


def test_strata_give_one_region_at_least(spark):
    rows = [(f"R{i}", 1, float(i)) for i in range(9)]
    held = splits.stratified_regions(spark.createDataFrame(rows, "region_id string, ordinal int, score double"))
    assert sorted(r.quartile for r in held.collect()) == [0, 1, 2, 3]


def test_blend_weights_sum_to_one():
    for g in (blending.grid(2), blending.grid(3), blending.grid_four(), blending.grid_tenths(), blending.grid_line()):
        assert all(abs(sum(w) - 1) < 1e-9 for w in g)


def test_padding(spark):
    df = series(spark, [1.0, 2.0], scores=[0.0, 1.0])
    assert [len(x) for x in column(sequences.zero_padded(df, ["prec"], 4), "seq")] == [4, 4]
    assert column(sequences.zero_padded(df, ["prec"], 4), "seq")[0] == [[0.0], [0.0], [0.0], [1.0]]
    template = spark.createDataFrame([("R1",), ("R9",)], "region_id string")
    got = {r.region_id: r.seq for r in sequences.last_repeat_padded(df, ["prec"], template, 4).collect()}
    assert got == {"R1": [[1.0], [1.0], [1.0], [2.0]], "R9": [[0.0]] * 4}


def test_unlabelled_region(spark):
    df = series(spark, range(10))
    assert weekly.to_weekly(weekly.labelled(df)).count() == 0
    assert summaries.region_summary(df.withColumn("year", F.lit(1)), ["prec"]).first().score_mean is None


def test_npz_and_csv(spark, tmp_path):
    np.savez(tmp_path / "t.npz", region_id=np.array([0, 1]), region_names=np.array(["R1", "R2"]), year=np.array([3004, 3004]), month=np.array([1, 1]), day=np.array([2, 3]), prec=np.array([1.0, np.nan], np.float32))
    got = [tuple(r) for r in files.read_panel_npz(spark, str(tmp_path / "t.npz"), ["prec", "tmp"]).orderBy("region_id").collect()]
    assert got == [("R1", 3004, 1, 2, 1.0, None, 3004 * 372 + 33), ("R2", 3004, 1, 3, None, None, 3004 * 372 + 34)]
    (tmp_path / "t.csv").write_text("region_id,date,prec,score\n R1 ,58061-01-02,1.5,\nR2,3004-01-02,x,nan\n")
    got = [(r.region_id, r.year, r.prec, r.score) for r in files.read_panel_csv(spark, str(tmp_path / "t.csv"), ["prec"]).orderBy("region_id").collect()]
    assert got == [("R1", 58061, 1.5, None), ("R2", 3004, None, None)]
    with pytest.raises(ValueError, match="region_id"):
        files.read_panel_csv(spark, str(tmp_path / "u.csv") if (tmp_path / "u.csv").write_text("a,date\n1,2\n") else "", ["prec"])


def test_archives_round_trip(spark, tmp_path):
    rows = [("R2", 3004, 1, 3, None), ("R1", 3004, 1, 3, 2.5), ("R1", 3004, 1, 2, 1.0), ("Ré", 3004, 1, 2, 7.0)]
    df = spark.createDataFrame(rows, "region_id string, year int, month int, day int, prec double")
    assert files.write_panel_npz(df, str(tmp_path / "a"), ["prec"], rows=1) == 4
    got = [tuple(r)[:5] for r in files.read_panel_npz(spark, str(tmp_path / "a"), ["prec"]).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert [f.name for f in (tmp_path / "a").iterdir() if not f.name.endswith(".npz")] == [files.WHOLE]
    assert files.write_panel_npz(df.limit(0), str(tmp_path / "b"), ["prec"]) == 0


def test_submission_keeps_the_template_order(spark, tmp_path):
    template = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "region_id string, place int")
    files.write_submission(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "region_id string, pred_week1 double"), template, str(tmp_path / "s"))
    lines = [x for f in sorted((tmp_path / "s").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("region_id")]
    assert lines == ["c,3.0", "a,1.0", "b,2.0"]


def test_boosting_stops_early_and_groups_of_names(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), *(float(rng.normal()) if i % 4 == 0 else float(a > 0) for _ in range(5)), i % 4 == 0) for i, a in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "prec double, y1 double, y2 double, y3 double, y4 double, y5 double, held boolean")
    few = models.Params("leaf", "squared", 30, 0.5, leaves=8, depth=0, patience=4)
    first, second = models.train_following(df, ["prec"], few, (1, 2), "held")
    assert max(first.tree_counts) < 30  # held rows follow no feature, so more trees don't help
    assert second.tree_counts == first.tree_counts == models.best_counts([first, second])
    gains = spark.createDataFrame([("prec", 1.0), ("prec_lag1", 2.0), ("dp_tmp_roll7_mean", 3.0), ("prec_roll7_mean", 4.0)], "feature string, gain double")
    got = {r.part: r.percent for r in models.importance_by_group(gains, 2).collect()}
    assert [got[k] for k in ("weather", "lags", "rolling_dp_tmp", "rolling", "spi", "top2")] == pytest.approx([10, 20, 30, 40, 0, 70])
    assert [tuple(r) for r in models.top_features(gains, 3).orderBy("place").collect()] == [(1, "prec_roll7_mean", 40.0, ""), (2, "dp_tmp_roll7_mean", 30.0, "NEW"), (3, "prec_lag1", 20.0, "")]


def test_replacement_that_stops_half_way(spark, tmp_path):
    """The old checkpoint is back after a stop between the two moves, and a finished one stays."""
    import shutil

    path = f"{tmp_path}/ckpt"
    one, two = spark.range(1), spark.range(2)
    files.write_atomic(one, path)
    shutil.move(path, path + files.ASIDE)  # stopped after the first move
    files.restore(spark, path)
    assert spark.read.parquet(path).count() == 1
    shutil.copytree(path, path + files.ASIDE)  # stopped before the old one was deleted
    files.write_atomic(two, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / ("ckpt" + files.ASIDE)).exists()


def test_half_written_archives_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/npz"
    df = spark.createDataFrame([("R1", 2000, 1, d, 1.5) for d in range(1, 9)], "region_id string, year int, month int, day int, prec double")
    files.write_panel_npz(df, folder, ["prec"], rows=3)
    assert files.read_panel_npz(spark, folder, ["prec"]).count() == 8
    (tmp_path / "npz" / files.WHOLE).unlink()
    with pytest.raises(FileNotFoundError):
        files.read_panel_npz(spark, folder, ["prec"])


def test_names_of_object_stores():
    from tarn.sources.shared import files_at

    for scheme in ("s3a", "s3n"):
        try:
            assert files_at(f"{scheme}://bucket/key")[1] == "bucket/key"
        except OSError as e:  # no network
            assert "Unrecognized" not in str(e)


def flat(spark):
    """x varies, flat never does, z is opposite to x; some values are missing."""
    return spark.createDataFrame([(1.0, 5.0, -1.0), (2.0, 5.0, -2.0), (None, 5.0, 9.0), (4.0, None, -4.0)], "x double, flat double, z double")


def same(got, want):
    assert [r[:-1] for r in got] == [w[:-1] for w in want]
    np.testing.assert_allclose([np.inf if r[-1] is None else r[-1] for r in got], [np.inf if w[-1] is None else w[-1] for w in want])


def test_correlations_of_a_constant(spark):
    nan = float("nan")
    got = [tuple(r) for r in summaries.correlations(flat(spark), ["x", "flat", "z"]).collect()]
    same(got, [("x", "x", 1.0), ("x", "flat", nan), ("x", "z", -1.0), ("flat", "flat", nan), ("flat", "z", nan), ("z", "z", 1.0)])
    assert [r.corr for r in summaries.correlations(flat(spark).filter("x > 9"), ["x", "z"]).collect()] == [None] * 3


def test_correlations_with_a_constant_target(spark):
    nan = float("nan")
    got = summaries.correlations_with(flat(spark), ["x", "z"], "flat")
    same([tuple(r) for r in got.collect()], [("x", nan), ("z", nan)])
    assert [r.column for r in summaries.top_by_size(got, "corr", 1).collect()] == ["x"]
    same([tuple(r) for r in summaries.correlations_with(flat(spark), ["z", "flat"], "x").collect()], [("z", -1.0), ("flat", nan)])


@pytest.mark.parametrize(("labels", "area"), [((1, 1, 1), float("nan")), ((0, 0, 0), float("nan")), ((0, 1, 1), 1.0)])
def test_auc_of_equal_labels(spark, labels, area):
    rows = spark.createDataFrame([(n, float(i)) for i, n in enumerate(labels)], "label long, score double")
    same([tuple(evaluation.auc(rows, "label", "score").first())], [(area,)])


def test_errors_of_constant_forecasts(spark):
    rows = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 1.0, 2.0), (2, 2.0, 3.0)], "horizon long, y double, pred double")
    got = evaluation.by_horizon(rows).orderBy("horizon").select("horizon", "corr").collect()
    same([tuple(r) for r in got], [(1, 0.0), (2, 1.0)])


def test_difference_of_constant_forecasts(spark):
    weeks = ", ".join(f"pred_week{k} double" for k in range(1, 6))
    a, b = (spark.createDataFrame([(r, *(x + r * v for v in (0, 1, 1, 1, 1))) for r in range(3)], f"region_id long, {weeks}") for x in (1.0, 2.0))
    got = evaluation.forecast_difference(a, b).orderBy("horizon").collect()
    same([tuple(r) for r in got], [(1, 1.0, float("nan")), *((k, 1.0, 1.0) for k in range(2, 6))])


def test_shares_without_gain(spark):
    gains = lambda *g: spark.createDataFrame(list(zip("ab", g, strict=True)), "feature string, gain double")
    got = summaries.cumulative_share(gains(0.0, 0.0)).orderBy("place").collect()
    assert [(r.feature, r.gain, r.place) for r in got] == [("a", 0.0, 1), ("b", 0.0, 2)]
    assert all(np.isnan([r.share, r.cumulative]).all() for r in got)
    assert [tuple(r) for r in summaries.cumulative_share(gains(1.0, 3.0)).orderBy("place").collect()] == [("b", 3.0, 0.75, 1, 0.75), ("a", 1.0, 0.25, 2, 1.0)]


@pytest.mark.parametrize("turned", [False, True])
def test_equal_extremes_go_to_the_smallest_key(spark, turned):
    rows = [(4, None), (3, 1.0), (1, 1.0), (2, 1.0), (7, 0.5), (6, 0.5)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "region_id long, mean double")
    assert tuple(summaries.extreme_keys(df.coalesce(1), "region_id", "mean").first()) == (1, 6)
    assert tuple(summaries.extreme_keys(df.filter("mean is null"), "region_id", "mean").first()) == (None, None)
