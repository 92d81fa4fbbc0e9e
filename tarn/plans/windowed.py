"""Queries of lags, rolling statistics, weekly rows, windows, splits, sequences and blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as ms
from ..operators import blending, features, frames, rolling, scores, sequences, splits, weekly
from ..operators import climatology as clim
from ..operators.evaluation import long_form
from ..sources.adapter import panel
from .aggregates import ROLLED, SPLIT, rolled_weekly
from .base import predictions, query, weekly_rows, window_rows
from .scalars import KEY, K, agg, c

R = "region_id"
O = "WINDOW o AS (PARTITION BY region_id ORDER BY ordinal)"  # noqa: E741
NAMES = {"mean": "avg", "std": "stddev_samp", "max": "max", "median": "median", "sum": "sum"}


def _lags(name: str, columns: tuple[str, ...], steps: tuple[int, ...]) -> None:
    sql = ", ".join(f"lag({x}, {k}) OVER o AS {x}_lag{k}" for x in columns for k in steps)
    query(name, f"SELECT {K}, {sql} FROM panel {O}", lambda s, d: panel(s, d).select(*KEY, *rolling.lags(columns, steps)), " ".join(f"{x}_lag{k}" for x in columns for k in steps))


# fixed values: the lagged columns and steps of the published versions
_LAG = ("tmp_range", "tmp_max", "tmp", "prec", "wind", "surf_pre", "humidity")
_lags("lag_weather", _LAG, (1, 3, 7, 14, 21))
_lags("lag_weather_v1", ("tmp_range", "tmp_max", "tmp", "prec", "wind", "surf_pre"), (1, 3, 7, 14, 21))
_lags("lag_weather_v8", _LAG, (1, 3, 7, 14, 21, 28))


def _rolls(name: str, columns: tuple[str, ...], widths: tuple[int, ...], stats: tuple[str, ...], least: rolling.MinRows = rolling.tenth) -> None:
    names = [f"{x}_roll{w}_{t}" for x in columns for w in widths for t in stats]
    sql = ", ".join(f"{agg(NAMES[t], x, -w, -1, least(w))} AS {x}_roll{w}_{t}" for x in columns for w in widths for t in stats)
    query(name, f"SELECT {K}, {sql} FROM panel", lambda s, d: frames.with_prior_stats(panel(s, d).select(*KEY, *columns), columns, widths, stats, least).select(*KEY, *names), " ".join(names))


_W = (7, 14, 30, 60, 90, 180)
_rolls("roll_mean", ("prec", "humidity", "tmp", "wind", "surf_pre", "dp_tmp"), _W, ("mean",))
_rolls("roll_std", ("prec", "humidity", "tmp", "wind", "surf_pre", "dp_tmp"), _W, ("std",))
_rolls("roll_max", ("prec", "humidity", "tmp", "wind", "surf_pre", "dp_tmp"), _W, ("max",))
_rolls("roll_short", ("prec", "tmp"), (7, 14, 30, 60, 90), ("mean", "std"))
_rolls("roll_long", ("prec", "tmp"), (*_W, 270, 365), ("mean", "max"))
_rolls("roll_fixed_min", ("prec", "tmp"), (7, 14, 28), ("mean", "std"), lambda w: 3)
_rolls("roll_quarter_min", ("prec", "tmp"), (7, 14, 30, 60, 90), ("mean", "std"), rolling.quarter)
_rolls("roll_median", ("prec", "tmp", "wind"), (7, 14, 30), ("median",))
_rolls("roll_sum", ("prec",), (7, 14, 28), ("sum",), lambda w: 3)
query("roll_prefix", f"SELECT {K}, " + ", ".join(f"{agg(f, 'prec', -w, -1, max(3, w // 10))} AS prec_roll{w}_{t}" for w in _W for f, t in (("avg", "mean"), ("stddev_samp", "std"))) + " FROM panel", lambda s, d: rolling.prior_means_by_prefix(panel(s, d), "prec", _W).select(*KEY, *(f"prec_roll{w}_{t}" for w in _W for t in ("mean", "std"))), " ".join(f"prec_roll{w}_{t}" for w in _W for t in ("mean", "std")))


def _over(name: str, parts: dict[str, tuple[str, object]], table: str = "panel") -> None:
    query(name, f"SELECT {K}, " + ", ".join(f"{sql} AS {n}" for n, (sql, _) in parts.items()) + f" FROM {table} {O}", lambda s, d: panel(s, d).select(*KEY, *(make().alias(n) for n, (_, make) in parts.items())), " ".join(parts))


def _mean(x: str, w: int, k: int) -> str:
    return agg("avg", x, -w, -1, k)


def _deficit(x: str) -> str:
    return f"{_mean(x, 90, 30)} - {_mean(x, 365, 60)}"


_over("roll_current", {"x": (agg("avg", "prec", -6, 0, 1), lambda: rolling.roll("prec", "mean", -6, 0, 1))})
_over("deficit_prec", {"x": (_deficit("prec"), lambda: features.deficit("prec"))})
_over("deficit_humidity", {"x": (_deficit("humidity"), lambda: features.deficit("humidity"))})
_over("anomaly_tmp", {"x": (_deficit("tmp"), lambda: features.deficit("tmp"))})
_over("deficit_prec_robust", {"x": (f"{_mean('prec', 90, 30)} - {agg('median', 'prec', -90, -1, 30)}", lambda: features.robust_deficit("prec"))})
_TREND = f"({_mean('prec', 7, 3)} - {_mean('prec', 30, 10)}) / greatest({agg('stddev_samp', 'prec', -30, -1, 10)}, CASE WHEN {agg('stddev_samp', 'prec', -30, -1, 10)} IS NOT NULL THEN 0.01 END)"
_over("trend_prec", {"x": (_TREND, lambda: features.trend("prec"))})
_over("heat_drought", {"x": (f"({_deficit('prec')}) * CASE WHEN ({_deficit('tmp')}) IS NOT NULL THEN greatest({_deficit('tmp')}, 0) END", lambda: features.deficit("prec") * ms.at_least(features.deficit("tmp"), 0.0))})
_over("tmp_mean_diff_90", {"x": (f"tmp - {_mean('tmp', 90, 10)}", lambda: c("tmp") - rolling.prior("tmp", "mean", 90, 10))})
_over("dtr_mean", {"a": (_mean("tmp_range", 14, 3), lambda: rolling.prior("tmp_range", "mean", 14, 3)), "b": (_mean("tmp_range", 30, 7), lambda: rolling.prior("tmp_range", "mean", 30, 7))})
_DRY = f"(SELECT *, CASE WHEN lag(prec) OVER o < 20 THEN 1.0::DOUBLE ELSE 0.0 END AS dry FROM panel {O})"
query("dry_days", f"SELECT {K}, {agg('sum', 'dry', -13, 0, 3)} AS dry_days_14d, {agg('sum', 'dry', -29, 0, 7)} AS dry_days_30d FROM {_DRY}", lambda s, d: rolling.dry_days(panel(s, d), limit=20.0).select(*KEY, "dry_days_14d", "dry_days_30d"), "dry_days_14d dry_days_30d")


def _stress(s: SparkSession, d: str) -> DataFrame:
    days = rolling.dry_days(panel(s, d), limit=20.0).withColumn("anom", features.deficit("tmp"))
    return days.select(*KEY, (c("dry_days_30d") * ms.at_least(c("anom"), 0.0)).alias("x"))


query("compound_stress", f"SELECT {K}, {agg('sum', 'dry', -29, 0, 7)} * CASE WHEN ({_deficit('tmp')}) IS NOT NULL THEN greatest({_deficit('tmp')}, 0) END AS x FROM {_DRY}", _stress, "x")
_V = [(w, t) for w in (7, 30, 90) for t in ("mean", "std", "max")]


def _vpd(s: SparkSession, d: str) -> DataFrame:
    days = panel(s, d).select(*KEY, ms.vpd_magnus(c("tmp"), c("humidity")).alias("vpd"))
    return frames.with_prior_stats(days, ("vpd",), (7, 30, 90), ("mean", "std", "max")).drop("vpd")


query("vpd_roll", f"SELECT {K}, " + ", ".join(f"{agg(NAMES[t], 'vpd', -w, -1, max(3, w // 10))} AS vpd_roll{w}_{t}" for w, t in _V) + " FROM (SELECT *, greatest(6.112 * exp(17.67 * tmp / (tmp + 243.5)) * (1 - humidity / 100), 0.0) AS vpd FROM panel)", _vpd, " ".join(f"vpd_roll{w}_{t}" for w, t in _V))
_EWM = "list_reverse(array_agg(prec) OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN 366 PRECEDING AND 1 PRECEDING))"
query(
    "ewm_prec",
    f"SELECT {K}, CASE WHEN len(l) >= 3 THEN list_sum(list_transform(l, lambda x, i: x * pow(13.0 / 15, i - 1))) / list_sum(list_transform(l, lambda x, i: pow(13.0 / 15, i - 1))) END AS x FROM (SELECT {K}, {_EWM} AS l FROM panel)",
    lambda s, d: rolling.ewm_prior(panel(s, d).select(*KEY, "prec"), "prec", 14, 3, "x").select(*KEY, "x"), "x",
)
query("spatial_mean", f"SELECT {K}, avg(prec) OVER (PARTITION BY ordinal ORDER BY region_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS prec_3, avg(tmp) OVER (PARTITION BY ordinal ORDER BY region_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS tmp_7 FROM panel", lambda s, d: panel(s, d).select(*KEY, rolling.neighbour_mean("prec", 3, R).alias("prec_3"), rolling.neighbour_mean("tmp", 7, R).alias("tmp_7")), "prec_3 tmp_7")

# seasons
query("seasonal_dev", f"SELECT {K}, " + ", ".join(f"{x} - avg({x}) OVER (PARTITION BY region_id, month) AS {x}_seasonal_dev" for x in ("prec", "humidity", "tmp")) + " FROM weekly", lambda s, d: clim.seasonal_deviation(weekly_rows(s, d), ("prec", "humidity", "tmp")).select(*KEY, *(f"{x}_seasonal_dev" for x in ("prec", "humidity", "tmp"))), "prec_seasonal_dev humidity_seasonal_dev tmp_seasonal_dev")
_FW = " ".join(f"rsm_fw_wk{k}" for k in range(1, 6))
_SEASON = lambda m: f"coalesce((SELECT mean FROM season s WHERE s.region_id = w.region_id AND s.month = {m}), (SELECT mean FROM means q WHERE q.region_id = w.region_id), 0)"
query("seasonal_forward_train", f"SELECT region_id, ordinal, {', '.join(f'{_SEASON(f"w.m{k}")} AS rsm_fw_wk{k}' for k in range(1, 6))} FROM (SELECT *, " + ", ".join(f"coalesce(lead(month, {k}) OVER o, last_value(month) OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS m{k}" for k in range(1, 6)) + f" FROM weekly {O}) w", lambda s, d: clim.seasonal_forward(weekly_rows(s, d), weekly.labelled(panel(s, d))).select(*KEY, *_FW.split()), _FW)
_TEST = f"(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ordinal DESC) AS r FROM {SPLIT} WHERE split = 'test') WHERE r = 1)"


def _test_rows(s: SparkSession, d: str) -> DataFrame:
    return weekly.last_rows(weekly.hide_last(panel(s, d)).filter("split = 'test'"), [R])


query("seasonal_forward_test", f"SELECT region_id, ordinal, {', '.join(f'{_SEASON(f"((((w.month - 1) * 31 + w.day + {7 * k}) - 1) // 31) % 12 + 1")} AS rsm_fw_wk{k}' for k in range(1, 6))} FROM {_TEST} w", lambda s, d: clim.seasonal_forward_test(_test_rows(s, d), weekly.labelled(panel(s, d))).select(*KEY, *_FW.split()), _FW)
query("test_row", f"SELECT {K}, prec FROM {_TEST}", lambda s, d: _test_rows(s, d).select(*KEY, "prec"), "prec")
query("test_row_tail", f"SELECT {K}, prec FROM {_TEST}", lambda s, d: weekly.tails(weekly.hide_last(panel(s, d)).filter("split = 'test'"), ["prec"]), "prec")
query("weekly_last", f"SELECT {K}, score FROM weekly", lambda s, d: weekly_rows(s, d).select(*KEY, "score"), "score")

# past scores
_T = ("prec_roll30_mean", "tmp_roll30_mean", "prec")
query("trajectory", f"SELECT {K}, " + ", ".join(f"coalesce({x} - lag({x}, 12) OVER o, 0) AS traj_{x}" for x in _T) + f" FROM {ROLLED} {O}", lambda s, d: scores.trajectory(rolled_weekly(s, d), list(_T)).select(*KEY, *(f"traj_{x}" for x in _T)), " ".join(f"traj_{x}" for x in _T))
query("trajectory_test", "SELECT region_id, " + ", ".join(f"arg_max({x}, ordinal) - arg_min({x}, ordinal) AS traj_{x}" for x in ("prec", "tmp")) + " FROM weekly GROUP BY 1", lambda s, d: scores.trajectory_test(weekly_rows(s, d), ["prec", "tmp"]), "traj_prec traj_tmp")
for _k, _n in ((3, "score_lag"), (5, "score_lag5"), (7, "score_lag7")):
    _sql = ", ".join("coalesce(" + ", ".join(f"lag(score, {x}) OVER o" for x in range(j, -1, -1)) + f") AS score_lag{j + 1}" for j in range(_k))
    query(_n, f"SELECT {K}, {_sql} FROM weekly {O}", lambda s, d, k=_k: scores.score_lags(weekly_rows(s, d), k).select(*KEY, *(f"score_lag{j}" for j in range(1, k + 1))), " ".join(f"score_lag{j}" for j in range(1, _k + 1)))
query("score_lag_gap", f"SELECT {K}, " + ", ".join(f"coalesce(lag(score, {13 + j}) OVER o, 0) AS score_lag{j + 1}" for j in range(3)) + f" FROM weekly {O}", lambda s, d: scores.score_lags_gap(weekly_rows(s, d)).select(*KEY, *(f"score_lag{j}" for j in (1, 2, 3))), "score_lag1 score_lag2 score_lag3")
query("score_lag_days", f"SELECT {K}, " + ", ".join(f"lag(score, {k}) OVER o AS score_lag{k}" for k in (14, 21, 28, 35)) + f" FROM panel {O}", lambda s, d: panel(s, d).select(*KEY, *rolling.lags(("score",), (14, 21, 28, 35))), "score_lag14 score_lag21 score_lag28 score_lag35")
query("score_lag_test", "SELECT region_id, " + ", ".join(f"coalesce(max(score) FILTER (n - i = {j}), max(score) FILTER (i = 0)) AS score_lag{j}" for j in range(1, 6)) + " FROM numbered GROUP BY 1", lambda s, d: scores.last_scores(weekly_rows(s, d), 5), " ".join(f"score_lag{j}" for j in range(1, 6)))


def _persist7(s: SparkSession, d: str) -> DataFrame:
    return panel(s, d).withColumn("f", rolling.forward_fill("score")).select(*KEY, F.lag("f", 7).over(rolling.by_time()).alias("x"))


query("score_persist7", f"SELECT {K}, lag(f, 7) OVER o AS x FROM (SELECT *, last_value(score IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM panel) {O}", _persist7, "x")
query("score_persist", f"SELECT {K}, coalesce(lag(score) OVER o, 0) AS x FROM weekly {O}", lambda s, d: weekly_rows(s, d).select(*KEY, F.coalesce(F.lag("score").over(rolling.by_time()), F.lit(0.0)).alias("x")), "x")
_ROWS = "OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN {} PRECEDING AND {})"
query("score_roll", f"SELECT {K}, avg(score) {_ROWS.format(3, 'CURRENT ROW')} AS score_mean_4w, coalesce(stddev_samp(score) {_ROWS.format(3, 'CURRENT ROW')}, 0) AS score_std_4w, avg(score) {_ROWS.format(7, 'CURRENT ROW')} AS score_mean_8w FROM weekly", lambda s, d: scores.score_windows(weekly_rows(s, d)).select(*KEY, "score_mean_4w", "score_std_4w", "score_mean_8w"), "score_mean_4w score_std_4w score_mean_8w")
_TWELVE = _ROWS.format(12, "1 PRECEDING")
_HIST = {"score_roll_prior": ("score_mean_4w_prior", f"coalesce(avg(score) {_ROWS.format(4, '1 PRECEDING')}, 0)"), "score_trend": ("score_trend_4w", "coalesce(lag(score, 1) OVER o - lag(score, 4) OVER o, 0)"), "score_streak": ("score_streak", f"coalesce(sum(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0 END) {_TWELVE}, 0)"), "prec_weeks_dry": ("prec_weeks_dry", f"coalesce(sum(CASE WHEN prec < 20 THEN 1.0::DOUBLE ELSE 0 END) {_TWELVE}, 0)")}
for _n, (_x, _sql) in _HIST.items():
    query(_n, f"SELECT {K}, {_sql} AS {_x} FROM weekly {O}", lambda s, d, x=_x: scores.score_history(weekly_rows(s, d), 20.0).select(*KEY, x), _x)

# windows and splits
_Y = ", ".join(splits.YS)
_YS = " ".join(splits.YS)
query("win_targets", f"SELECT {K}, i, {_Y} FROM windows", lambda s, d: window_rows(s, d).select(*KEY, "i", *splits.YS), _YS)
query("win_stride", f"SELECT {K}, i, {_Y} FROM windows WHERE i % 3 = 0 OR i = n - 6", lambda s, d: window_rows(s, d, 3).select(*KEY, "i", *splits.YS), _YS)
query("win_mean_target", f"SELECT {K}, (y2 + y3 + y4) / 3 AS y FROM windows", lambda s, d: splits.mean_target(window_rows(s, d), (2, 3, 4)).select(*KEY, "y"), "y")
_RANDOM = "(SELECT region_id FROM (SELECT region_id, row_number() OVER (ORDER BY md5(region_id || ':42'), region_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT region_id FROM weekly)) WHERE r <= greatest(1, floor(n * 0.2)))"
query("split_random", f"SELECT region_id FROM {_RANDOM}", lambda s, d: splits.random_regions(weekly_rows(s, d)))
_QUART = "(SELECT region_id, m, len(list_filter(list_distinct(e), lambda x: x < m AND x > lo AND x < hi)) AS quartile FROM (SELECT region_id, coalesce(avg(score), 0) AS m FROM weekly GROUP BY 1), (SELECT quantile_cont(m, [0.25, 0.5, 0.75]) AS e, min(m) AS lo, max(m) AS hi FROM (SELECT coalesce(avg(score), 0) AS m FROM weekly GROUP BY region_id)))"
_STRAT = f"(SELECT region_id, CAST(quartile AS BIGINT) AS quartile FROM (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY md5(region_id || ':42'), region_id) AS r, count(*) OVER (PARTITION BY quartile) AS n FROM {_QUART}) WHERE r <= greatest(1, floor(n * 0.2)))"
query("split_stratified", f"SELECT region_id, quartile FROM {_STRAT}", lambda s, d: splits.stratified_regions(weekly_rows(s, d)))
query("split_diag", f"SELECT *, CASE WHEN diff < 0.02 THEN 'good' WHEN diff < 0.05 THEN 'check' ELSE 'bad' END AS status FROM (SELECT *, abs(val_mean - train_mean) AS diff FROM (SELECT avg(score) FILTER (region_id NOT IN (SELECT region_id FROM {_STRAT})) AS train_mean, avg(score) FILTER (region_id IN (SELECT region_id FROM {_STRAT})) AS val_mean FROM weekly))", lambda s, d: (lambda w: splits.split_check(w, splits.stratified_regions(w)))(weekly_rows(s, d)), "train_mean val_mean diff")
query("split_holdout_val", f"SELECT {K}, CASE WHEN region_id IN (SELECT region_id FROM {_STRAT}) THEN 'val' ELSE 'train' END AS part FROM windows WHERE region_id NOT IN (SELECT region_id FROM {_STRAT}) OR i = n - 6", lambda s, d: splits.holdout(window_rows(s, d), splits.stratified_regions(weekly_rows(s, d))).select(*KEY, "part"))


def _part(name: str, val: str, train: str, where: str, make) -> None:
    query(name, f"SELECT {K}, part FROM (SELECT *, CASE WHEN {val} THEN 'val' WHEN {train} THEN 'train' END AS part FROM windows WHERE {where}) WHERE part IS NOT NULL", lambda s, d: make(window_rows(s, d)).select(*KEY, "part"))


_part("split_lastwindow", "i = n - 6", "true", "true", splits.last_windows)
_part("split_lastk", "i >= n - 10", "true", "true", lambda w: splits.last_windows(w, 5))
_part("split_lastyear", "i >= n - 57", "true", "true", lambda w: splits.last_windows(w, 52))
_part("split_temporal_safe", "i = n - 6", "i < n - 10", "n >= 11", splits.temporal_safe)
_part("split_valweeks", "i >= n - 10", "i < n - 14", "n >= 16", splits.last_weeks)


def _cutoff(s: SparkSession, d: str) -> DataFrame:
    rows = weekly_rows(s, d)
    whole = rows.agg(F.max("ordinal").alias("last"))
    return splits.common_cutoff(splits.windows(rows).join(F.broadcast(whole)), 26).select(*KEY, "part")


query("split_cutoff", f"SELECT {K}, CASE WHEN i = v THEN 'val' ELSE 'train' END AS part FROM (SELECT *, max(i) FILTER (ordinal <= (SELECT max(ordinal) FROM weekly) - 182) OVER (PARTITION BY region_id) AS v FROM windows) WHERE n >= 7 AND v >= 1 AND i <= v", _cutoff)
query("folds_rolling", f"SELECT {K}, fold, part FROM (SELECT *, CASE WHEN i = n - fold * 5 - 6 THEN 'val' WHEN i < n - fold * 5 - 11 THEN 'train' END AS part FROM windows, (SELECT CAST(range AS BIGINT) AS fold FROM range(5)) WHERE n >= fold * 5 + 30) WHERE part IS NOT NULL", lambda s, d: splits.rolling_folds(window_rows(s, d)).select(*KEY, "fold", "part"))
query("folds_offset", f"SELECT {K}, fold, part FROM (SELECT *, CASE WHEN i = n - 6 - fold THEN 'val' WHEN i <= n - 11 - fold THEN 'train' END AS part FROM windows, (SELECT unnest([0, 5, 10])::BIGINT AS fold) WHERE n > 10 + fold) WHERE part IS NOT NULL", lambda s, d: splits.offset_folds(window_rows(s, d)).select(*KEY, "fold", "part"))
_DIGEST = "md5(region_id || ':' || ordinal || ':42')"
query("kfold", f"SELECT {K}, CAST(('0x' || substr({_DIGEST}, 1, 8))::BIGINT % 3 AS BIGINT) AS fold FROM weekly", lambda s, d: splits.kfold(weekly_rows(s, d), KEY).select(*KEY, "fold"))
query("subsample", f"SELECT {K} FROM weekly ORDER BY {_DIGEST}, {K} LIMIT 200", lambda s, d: splits.subsample(weekly_rows(s, d), KEY, 200).select(*KEY))
query("sample_labelled", f"SELECT {K}, score FROM labelled ORDER BY {_DIGEST}, {K} LIMIT 300", lambda s, d: splits.subsample(weekly.labelled(panel(s, d)), KEY, 300).select(*KEY, "score"), "score")

# sequences: digests of the arrays, so that engines can be compared
_F = ("prec", "score")


def _flat(df: DataFrame) -> DataFrame:
    rows = F.transform("seq", lambda r: F.array_join(F.transform(r, lambda x: F.format_string("%.3f", x)), ","))
    return df.withColumn("seq", F.array_join(rows, ";"))


_FMT = "printf('%.3f', {0}) || ',' || printf('%.3f', {1})"
_LIST = f"array_agg({_FMT.format('prec', 'score')}) OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN {{}} PRECEDING AND CURRENT ROW)"
_ZERO = "list_transform(range({}), lambda x: '0.000,0.000')"
query("seq_windows", f"SELECT {K}, array_to_string(l, ';') AS seq, {_Y} FROM (SELECT *, {_LIST.format(12)} AS l FROM aimed) WHERE len(l) = 13 AND y5 IS NOT NULL", lambda s, d: _flat(sequences.full(weekly_rows(s, d), _F)), _YS)
query("seq_zero_pad", f"SELECT {K}, array_to_string(list_concat({_ZERO.format('26 - len(l)')}, l), ';') AS seq FROM (SELECT *, {_LIST.format(25)} AS l FROM weekly)", lambda s, d: _flat(sequences.zero_padded(weekly_rows(s, d), _F)))
_TAIL = f"(SELECT region_id, array_agg({_FMT.format('prec', 'score')} ORDER BY ordinal) AS l FROM numbered WHERE i >= n - 13 GROUP BY 1)"
query("seq_repeat_pad", f"SELECT t.region_id, array_to_string(CASE WHEN l IS NULL THEN {_ZERO.format(13)} ELSE list_concat(list_transform(range(13 - len(l)), lambda x: l[1]), l) END, ';') AS seq FROM (SELECT CAST(range AS BIGINT) AS region_id FROM range(30)) t LEFT JOIN {_TAIL} f ON t.region_id = f.region_id", lambda s, d: _flat(sequences.last_repeat_padded(weekly_rows(s, d), _F, s.range(30).select(c("id").alias(R)))))
query("seq_test_concat", f"SELECT region_id, array_to_string(array_agg({_FMT.format('prec', 'coalesce(score, 0)')} ORDER BY ordinal), ';') AS seq FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ordinal DESC) AS q FROM {SPLIT}) WHERE q <= 13 GROUP BY 1", lambda s, d: (lambda p: _flat(sequences.last_repeat_padded(p, _F, p)))(weekly.hide_last(panel(s, d))))
query("scale_z", f"SELECT {K}, (prec - (SELECT avg(prec) FROM labelled)) / greatest((SELECT stddev_pop(prec) FROM labelled), 1e-6) AS prec_scaled FROM weekly", lambda s, d: sequences.scale(weekly_rows(s, d), ["prec"], weekly.labelled(panel(s, d))).select(*KEY, "prec_scaled"), "prec_scaled")

# baselines and blends
query("persistence", "SELECT region_id, arg_max(score, ordinal) AS pred FROM weekly GROUP BY 1", lambda s, d: weekly_rows(s, d).groupBy(R).agg(F.max_by("score", "ordinal").alias("pred")), "pred")
query("median_baseline", "SELECT horizon, avg(abs(d - y)) AS mae FROM preds GROUP BY 1", lambda s, d: predictions(s, d).groupBy("horizon").agg(F.avg(F.abs(c("d") - c("y"))).alias("mae")), "mae")
query("multi_seed", "SELECT region_id, horizon, (a + b + c) / 3 AS pred FROM preds", lambda s, d: predictions(s, d).select(R, "horizon", (blending.mix([1.0, 1.0, 1.0], ["a", "b", "c"]) / 3).alias("pred")), "pred")


def _blend(name: str, models: str, weights: list[blending.Weights]) -> None:
    n = len(models)
    values = ", ".join("(" + ", ".join(map(str, (i, *w))) + ")" for i, w in enumerate(weights))
    ws = [f"w{j + 1}" for j in range(n)]
    mixed = " + ".join(f"{w} * {m}" for w, m in zip(ws, models, strict=True))
    typed = ", ".join(f"{w}::DOUBLE AS {w}" for w in ws)
    sql = f"SELECT {', '.join(ws)}, mae FROM (SELECT nth, {', '.join(ws)}, avg(abs(least(greatest({mixed}, 0), 5) - y)) AS mae FROM preds, (SELECT nth, {typed} FROM (VALUES {values}) AS g(nth, {', '.join(ws)})) GROUP BY ALL) ORDER BY round(mae, 12), nth LIMIT 1"
    query(name, sql, lambda s, d: blending.best(predictions(s, d), list(models), weights), " ".join([*ws, "mae"]))


_blend("blend_grid", "abc", blending.grid(3))
_blend("blend_grid2", "ab", blending.grid(2))
_blend("blend_grid4", "abcd", blending.grid_four())
_blend("blend_grid_v7", "abc", blending.grid_tenths())
_blend("blend_line", "ab", blending.grid_line())
query("blend_persist", "SELECT region_id, horizon, 0.65 * c + 0.35 * b AS pred FROM preds", lambda s, d: predictions(s, d).select(R, "horizon", blending.with_persistence(c("c"), c("b")).alias("pred")), "pred")
query("hurdle_gate", "SELECT alpha, mae FROM (SELECT alpha, avg(abs(least(greatest((alpha * p + 1 - alpha) * c, 0), 5) - y)) AS mae FROM preds, (SELECT range * 0.05::DOUBLE AS alpha FROM range(21)) GROUP BY 1) ORDER BY round(mae, 12), alpha LIMIT 1", lambda s, d: blending.gate(predictions(s, d), "c", "p"), "alpha mae")
query("calibrate_median", "SELECT CASE WHEN u THEN s ELSE 0 END AS shift, mae_before, CASE WHEN u THEN moved ELSE mae_before END AS mae_after FROM (SELECT *, abs(s) > 0.02 AND moved < mae_before AS u FROM (SELECT any_value(s) AS s, avg(abs(c - y)) AS mae_before, avg(abs(least(greatest(c + s, 0), 5) - y)) AS moved FROM preds, (SELECT median(y) - median(c) AS s FROM preds)))", lambda s, d: blending.median_shift(predictions(s, d).withColumn("pred", c("c"))), "shift mae_before mae_after")
query("round_choice", "SELECT *, mae_rounded < mae_plain AS use_rounded FROM (SELECT avg(abs(c - y)) AS mae_plain, avg(abs(round_even(c, 0) - y)) AS mae_rounded FROM preds)", lambda s, d: blending.rounding(predictions(s, d).withColumn("pred", c("c"))), "mae_plain mae_rounded")


def _slice(s: SparkSession, d: str) -> DataFrame:
    """One week's persistence error by horizon, with a rolling mean beside it: the smallest whole query."""
    days = panel(s, d).select(*KEY, "score", rolling.prior("prec", "mean", 30, 3).alias("prec_roll30_mean"))
    w = splits.windows(weekly.to_weekly(weekly.labelled(days)))
    each = long_form(w.withColumn("b", c("score")), {"pred": ["b"] * 5}, keep=(R, "i", "prec_roll30_mean"))
    return each.groupBy("horizon").agg(F.avg(F.abs(c("pred") - c("y"))).alias("mae"), F.avg("prec_roll30_mean").alias("prec"), F.count("*").alias("n"))


query("flagship", f"SELECT k AS horizon, avg(abs(score - y)) AS mae, avg(q) AS prec, count(*) AS n FROM (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS k, unnest([{_Y}]) AS y, w.score, q FROM windows w JOIN (SELECT {K}, {agg('avg', 'prec', -30, -1, 3)} AS q FROM panel) p ON w.region_id = p.region_id AND w.ordinal = p.ordinal) GROUP BY 1", _slice, "mae prec")
