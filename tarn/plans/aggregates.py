"""Queries of aggregates, joins and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climatology as clim
from ..operators import evaluation as ev
from ..operators import summaries, weekly
from ..operators.features import FeatureSet
from ..operators.quantiles import quantile_row
from ..operators.splits import last_windows
from ..sources import files
from ..sources.adapter import panel
from .base import predictions, query, weekly_rows, window_rows
from .scalars import KEY, K, agg, c, scratch

COLS = ("prec", "tmp", "humidity", "wind")
R = "region_id"
SPI_SET = FeatureSet(raw=(), lag_columns=(), roll_columns=("prec", "tmp"), roll_widths=(30, 90, 180), stats=("mean",), with_indices=False)

rolled = ", ".join(f"{agg('avg', x, -w, -1, max(3, w // 10))} AS {x}_roll{w}_mean" for x in ("prec", "tmp") for w in (30, 90, 180))
#: Weekly rows with rolling means, for climatologies.
ROLLED = f"(SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY region_id, ordinal // 7 ORDER BY ordinal DESC) AS nth FROM (SELECT *, {rolled} FROM panel) WHERE score IS NOT NULL) WHERE nth = 1)"


def rolled_weekly(s: SparkSession, d: str) -> DataFrame:
    return weekly.to_weekly(weekly.labelled(SPI_SET.daily(panel(s, d))))


query("agg_region_mean", "SELECT region_id, avg(score) AS mean_score FROM panel GROUP BY 1", lambda s, d: clim.means(panel(s, d), [R]), "mean_score")
query("agg_region_month_mean", "SELECT region_id, month, avg(score) AS mean_score FROM labelled GROUP BY 1, 2", lambda s, d: clim.means(weekly.labelled(panel(s, d)), [R, "month"]), "mean_score")
query("agg_region_week_mean", "SELECT region_id, ((month - 1) * 31 + day) // 7 AS week, avg(score) AS mean_score FROM labelled GROUP BY 1, 2", lambda s, d: clim.means(weekly.labelled(panel(s, d)).withColumn("week", F.floor(((c("month") - 1) * 31 + c("day")) / 7)), [R, "week"]), "mean_score")
_SPI = ", ".join(f"avg({x}) AS {x}_m, CASE WHEN stddev_samp({x}) IS NOT NULL THEN greatest(stddev_samp({x}), 0.1) END AS {x}_s" for x in ("prec_roll30_mean", "prec_roll90_mean", "prec_roll180_mean", "tmp_roll90_mean"))
_SPI_NAMES = " ".join(f"{x}_{y}" for x in ("prec_roll30_mean", "prec_roll90_mean", "prec_roll180_mean", "tmp_roll90_mean") for y in "ms")
query("agg_spi_stats", f"SELECT region_id, month, {_SPI} FROM {ROLLED} GROUP BY 1, 2", lambda s, d: clim.spi_statistics(rolled_weekly(s, d)), _SPI_NAMES)
EXT = (*clim.SPI, ("tmp", 30), ("tmp", 180))
query("agg_spi_stats_ext", f"SELECT region_id, month, {_SPI}, " + ", ".join(f"avg({x}) AS {x}_m, CASE WHEN stddev_samp({x}) IS NOT NULL THEN greatest(stddev_samp({x}), 0.1) END AS {x}_s" for x in ("tmp_roll30_mean", "tmp_roll180_mean")) + f" FROM {ROLLED} GROUP BY 1, 2", lambda s, d: clim.spi_statistics(rolled_weekly(s, d), EXT), _SPI_NAMES + " tmp_roll30_mean_m tmp_roll30_mean_s tmp_roll180_mean_m tmp_roll180_mean_s")
_CLIM = ", ".join(f"avg({x}) AS {x}_m, stddev_samp({x}) AS {x}_s" for x in COLS)
query("agg_climatology", f"SELECT region_id, month, {_CLIM} FROM panel GROUP BY 1, 2", lambda s, d: clim.monthly(panel(s, d), COLS), " ".join(f"{x}_{y}" for x in COLS for y in "ms"))
query("agg_region_stats", "SELECT region_id, avg(score) AS region_mean, median(score) AS region_median, coalesce(stddev_samp(score), 0) AS region_std FROM panel GROUP BY 1", lambda s, d: clim.region_statistics(panel(s, d)), "region_mean region_median region_std")
query("agg_region_median", "SELECT region_id, coalesce(median(score), (SELECT median(score) FROM panel)) AS median_score FROM panel GROUP BY 1", lambda s, d: clim.region_medians(panel(s, d)), "median_score")
_SUM = "SELECT region_id, count(*) AS n_rows, count(score) AS n_scored, count(score)::DOUBLE / count(*) AS score_rate, avg(score) AS score_mean, min(year) AS year_min, max(year) AS year_max, " + ", ".join(f"avg({x}) AS {x}_mean" for x in COLS) + " FROM panel GROUP BY 1"
_SUM_DOUBLES = "score_rate score_mean " + " ".join(f"{x}_mean" for x in COLS)
query("agg_region_summary", _SUM, lambda s, d: summaries.region_summary(panel(s, d), COLS), _SUM_DOUBLES)


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Sums of three parts of the panel, taken apart and merged."""
    p = panel(s, d)
    return summaries.merge_partials([summaries.region_partial(p.filter(F.col("year") % 3 == k), COLS) for k in range(3)], COLS)


query("agg_merge_chunks", _SUM, _merged, _SUM_DOUBLES)


def _summary_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    found = summaries.region_summary(panel(s, d), COLS)
    files.write_table_csv(found, path)
    return s.read.option("header", True).schema(found.schema).csv(path)


query("snk_region_summary", _SUM, _summary_file, _SUM_DOUBLES)
query("agg_chunk_summary", "SELECT count(*) AS n_rows, count(score) AS n_scored, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, " + ", ".join(f"count(*) - count({x}) AS {x}_nulls" for x in (*COLS, "score")) + " FROM panel", lambda s, d: summaries.table_summary(panel(s, d), (*COLS, "score")))
query("agg_region_score_desc", "SELECT region_id, avg(score) AS mean, stddev_samp(score) AS std, max(score) AS max, count(score) AS count FROM panel GROUP BY 1", lambda s, d: summaries.score_description(panel(s, d)), "mean std max")
query("agg_date_minmax", "SELECT region_id, min(ordinal) AS first, max(ordinal) AS last FROM panel GROUP BY 1", lambda s, d: panel(s, d).groupBy(R).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")))
query("agg_monthly", "SELECT month, avg(tmp) AS tmp, avg(prec) AS prec, avg(wind) AS wind, avg(score) AS score FROM panel GROUP BY 1", lambda s, d: panel(s, d).groupBy("month").agg(*(F.avg(x).alias(x) for x in ("tmp", "prec", "wind", "score"))), "tmp prec wind score")
query("agg_by_day", "SELECT day, count(*) AS n FROM labelled GROUP BY 1", lambda s, d: weekly.labelled(panel(s, d)).groupBy("day").agg(F.count("*").alias("n")))
query("value_counts", "SELECT score AS value, count(*) AS n FROM panel GROUP BY 1", lambda s, d: summaries.value_counts(panel(s, d), "score"), "value")
query("null_profile", " UNION ALL ".join(f"SELECT '{x}' AS column, count(*) - count({x}) AS nulls, (count(*) - count({x})) * 100.0::DOUBLE / count(*) AS percent FROM panel" for x in (*COLS, "score")), lambda s, d: summaries.null_profile(panel(s, d), (*COLS, "score")), "percent")
query("describe", " UNION ALL ".join(f"SELECT '{x}' AS column, count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, max({x}) AS max FROM panel" for x in (*COLS, "score")), lambda s, d: summaries.describe(panel(s, d), (*COLS, "score")), "mean std min q25 q50 q75 max")
query("quantile_global", "SELECT quantile_cont(prec, 0.999) AS q999, quantile_cont(prec, 0.95) AS q95 FROM panel", lambda s, d: quantile_row(panel(s, d), {"q999": ("prec", 0.999), "q95": ("prec", 0.95)}), "q999 q95")
query("nunique", "SELECT count(DISTINCT region_id) AS n FROM panel", lambda s, d: panel(s, d).agg(F.count_distinct(R).alias("n")))
query("last_per_region", "SELECT region_id, arg_max(score, ordinal) AS last FROM weekly GROUP BY 1", lambda s, d: weekly_rows(s, d).groupBy(R).agg(F.max_by("score", "ordinal").alias("last")), "last")
_NUM = ("prec", "tmp", "humidity", "wind", "tmp_min", "tmp_max", "score")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i:]]
query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM panel" for a, b in _PAIRS), lambda s, d: summaries.correlations(panel(s, d), _NUM), "corr")
query("corr_target", " UNION ALL ".join(f"SELECT '{x}' AS column, corr({x}, score) AS corr FROM panel" for x in _NUM[:-1]), lambda s, d: summaries.correlations_with(panel(s, d), _NUM[:-1]), "corr")
_LAGS = [(x, k) for x in COLS for k in (1, 7, 14, 30, 60)]
_LAG_TABLE = f"(SELECT score, {', '.join(f'lag({x}, {k}) OVER o AS {x}_lag{k}' for x, k in _LAGS)} FROM panel WINDOW o AS (PARTITION BY region_id ORDER BY ordinal))"
# the reference's six columns and its lags of a day to three weeks, beside those of the feature sets
_LAGGED, _STEPS = (*COLS, "tmp_range", "surf_pre"), (1, 3, 7, 14, 21, 30, 60)
query("corr_lags", " UNION ALL ".join(f"SELECT '{x}_lag{k}' AS column, corr(x, score) AS corr FROM (SELECT score, lag({x}, {k}) OVER (PARTITION BY region_id ORDER BY ordinal) AS x FROM panel)" for x in _LAGGED for k in _STEPS), lambda s, d: summaries.correlations_with(summaries.lagged(panel(s, d), _LAGGED, _STEPS), [f"{x}_lag{k}" for x in _LAGGED for k in _STEPS]), "corr")
query("topk_abs", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{x}_lag{k}' AS column, corr({x}_lag{k}, score) AS corr FROM {_LAG_TABLE}" for x, k in _LAGS) + ") ORDER BY abs(corr) DESC, 1 LIMIT 10", lambda s, d: summaries.top_by_size(summaries.correlations_with(summaries.lagged(panel(s, d), COLS, (1, 7, 14, 30, 60)), [f"{x}_lag{k}" for x, k in _LAGS]), "corr", 10), "corr")
_NOW = [(x, f, n) for x in COLS for f, n in (("avg", "mean"), ("stddev_samp", "std"))]
_NOW_TABLE = f"(SELECT score, {', '.join(f'{agg(f, x, -6, 0, 1)} AS {x}_now7_{n}' for x, f, n in _NOW)} FROM panel)"
query("corr_rolls", " UNION ALL ".join(f"SELECT '{x}_now7_{n}' AS column, corr({x}_now7_{n}, score) AS corr FROM {_NOW_TABLE}" for x, f, n in _NOW), lambda s, d: summaries.correlations_with(summaries.rolled_now(panel(s, d), COLS), [f"{x}_now7_{n}" for x, _, n in _NOW]), "corr")
query("corr_ecological", " UNION ALL ".join(f"SELECT '{x}' AS column, corr(x, score) AS corr FROM (SELECT avg({x}) AS x, avg(score) AS score FROM panel GROUP BY region_id)" for x in COLS), lambda s, d: summaries.correlations_with(panel(s, d).groupBy(R).agg(*(F.avg(x).alias(x) for x in (*COLS, "score"))), COLS), "corr")
query("extreme_contrast", " UNION ALL ".join(f"SELECT '{x}' AS column, avg(score) FILTER ({x} > q) AS mean_high, avg(score) FILTER ({x} <= q) AS mean_rest, count(*) FILTER ({x} > q) AS n_high, count(*) FILTER ({x} <= q) AS n_rest FROM labelled, (SELECT quantile_cont({x}, 0.95) AS q FROM labelled)" for x in COLS), lambda s, d: summaries.extreme_contrast(panel(s, d), COLS), "mean_high mean_rest")
SPLIT = "(SELECT * REPLACE (CASE WHEN nth > 91 THEN score END AS score), CASE WHEN nth <= 91 THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ordinal DESC) AS nth FROM panel))"
query("range_compare", " UNION ALL ".join(f"SELECT '{x}' AS column, min({x}) FILTER (split = 'train') AS train_min, max({x}) FILTER (split = 'train') AS train_max, min({x}) FILTER (split = 'test') AS test_min, max({x}) FILTER (split = 'test') AS test_max FROM {SPLIT}" for x in COLS), lambda s, d: summaries.range_compare(weekly.hide_last(panel(s, d)), COLS), "train_min train_max test_min test_max")
_EDGES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
query("hist_score", "SELECT " + " + ".join(f"CAST(mean >= {e} AS BIGINT)" for e in _EDGES[1:]) + " AS band, count(*) AS n FROM means WHERE mean IS NOT NULL GROUP BY 1", lambda s, d: summaries.score_bands(panel(s, d), _EDGES))
query("agg_test91", "SELECT region_id, " + ", ".join(f"avg({x}) AS test91_{x}_mean, max({x}) AS test91_{x}_max, min({x}) AS test91_{x}_min" for x in COLS) + f" FROM {SPLIT} WHERE split = 'test' GROUP BY 1", lambda s, d: weekly.hide_last(panel(s, d)).filter("split = 'test'").groupBy(R).agg(*(f(x).alias(f"test91_{x}_{n}") for x in COLS for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min)))), " ".join(f"test91_{x}_{n}" for x in COLS for n in ("mean", "max", "min")))

# errors
_P = lambda s, d: predictions(s, d).withColumn("pred", c("c"))
query("mae", "SELECT avg(abs(least(greatest(c, 0), 5) - y)) AS mae FROM preds", lambda s, d: ev.mae(_P(s, d)), "mae")
query("err_by_week", "SELECT horizon, avg(abs(c - y)) AS mae, avg(c - y) AS bias, CASE WHEN stddev_pop(y) < 1e-6 OR stddev_pop(c) < 1e-6 THEN 0 ELSE corr(y, c) END AS corr FROM preds GROUP BY 1", lambda s, d: ev.by_horizon(_P(s, d)), "mae bias corr")
query("err_by_bucket", "SELECT CAST(least(floor(y), 4) AS BIGINT) AS band, count(*) AS n, avg(abs(c - y)) AS mae, avg(abs(c - y)) - (SELECT avg(abs(c - y)) FROM preds) AS delta FROM preds GROUP BY 1", lambda s, d: ev.by_band(_P(s, d)), "mae delta")
query("var_over_weeks", "SELECT avg(v) AS variance FROM (SELECT var_pop(y) AS v FROM preds GROUP BY region_id, i)", lambda s, d: ev.variation_over_weeks(predictions(s, d).withColumn("pred", c("y"))), "variance")
query("auc", "SELECT (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))) AS auc FROM (SELECT sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n, (sum(count(*)) OVER (ORDER BY prec) - count(*) + (count(*) + 1) / 2.0)::DOUBLE AS r FROM (SELECT prec, CAST(score > 0 AS BIGINT) AS label FROM labelled) GROUP BY prec)", lambda s, d: ev.auc(weekly.labelled(panel(s, d)).select("prec", (c("score") > 0).cast("long").alias("label")), "label", "prec"), "auc")
_M = ", ".join(f"coalesce(t.m{k}, g.m{k}) AS region_median_week{k}" for k in range(1, 6))
_MEDS = ", ".join(f"median(y{k}) AS m{k}" for k in range(1, 6))
query("target_enc_median", f"SELECT v.region_id, v.i, {_M} FROM (SELECT * FROM windows WHERE i = n - 6) v LEFT JOIN (SELECT region_id, {_MEDS} FROM windows WHERE i < n - 6 GROUP BY 1) t ON v.region_id = t.region_id, (SELECT {_MEDS} FROM windows WHERE i < n - 6) g", lambda s, d: (lambda w: ev.encode_medians(w.filter("part = 'train'"), w.filter("part = 'val'").select(R, "i")))(last_windows(window_rows(s, d))), " ".join(f"region_median_week{k}" for k in range(1, 6)))

# joins
_SPI_JOIN = ", ".join(f"(w.{x}_roll{n}_mean - m.{x}_roll{n}_mean_m) / m.{x}_roll{n}_mean_s AS {x}_spi{n}" for x, n in clim.SPI)
for _n in ("join_spi", "spi"):
    query(_n, f"SELECT w.region_id, w.ordinal, {_SPI_JOIN} FROM {ROLLED} w LEFT JOIN (SELECT region_id, month, {_SPI} FROM {ROLLED} GROUP BY 1, 2) m ON w.region_id = m.region_id AND w.month = m.month", lambda s, d: (lambda w: clim.spi(w, clim.spi_statistics(w)).select(*KEY, *(f"{x}_spi{n}" for x, n in clim.SPI)))(rolled_weekly(s, d)), " ".join(f"{x}_spi{n}" for x, n in clim.SPI))
_Z = ", ".join(f"(p.{x} - m.{x}_m) / CASE WHEN m.{x}_s < 1e-8 THEN 1.0 ELSE coalesce(m.{x}_s, 1.0) END AS {x}_z" for x in COLS)
for _n in ("join_clim", "zscore_clim"):
    query(_n, f"SELECT p.region_id, p.ordinal, {_Z} FROM panel p LEFT JOIN (SELECT region_id, month, {_CLIM} FROM panel GROUP BY 1, 2) m ON p.region_id = m.region_id AND p.month = m.month", lambda s, d: (lambda p: clim.zscores(p, clim.monthly(p, COLS), COLS).select(*KEY, *(f"{x}_z" for x in COLS)))(panel(s, d)), " ".join(f"{x}_z" for x in COLS))
_ZG = ", ".join(f"(p.{x} - coalesce(m.{x}_m, g.{x}_gm)) / CASE WHEN coalesce(m.{x}_s, g.{x}_gs) < 1e-8 THEN 1.0 ELSE coalesce(m.{x}_s, g.{x}_gs, 1.0) END AS {x}_z" for x in COLS)
_HALF = f"(SELECT region_id, month, {_CLIM} FROM {SPLIT} WHERE split = 'train' GROUP BY 1, 2)"
query("join_clim_global", f"SELECT p.region_id, p.ordinal, {_ZG} FROM panel p LEFT JOIN {_HALF} m ON p.region_id = m.region_id AND p.month = m.month, (SELECT {', '.join(f'avg({x}_m) AS {x}_gm, avg({x}_s) AS {x}_gs' for x in COLS)} FROM {_HALF}) g", lambda s, d: (lambda p: clim.zscores(p, clim.monthly(weekly.hide_last(p).filter("split = 'train'"), COLS), COLS, True).select(*KEY, *(f"{x}_z" for x in COLS)))(panel(s, d)), " ".join(f"{x}_z" for x in COLS))
query("map_region", "SELECT w.region_id, ordinal, mean AS mean_score FROM weekly w LEFT JOIN means m ON w.region_id = m.region_id", lambda s, d: clim.with_lookup(weekly_rows(s, d), clim.means(panel(s, d), [R]), [R]).select(*KEY, "mean_score"), "mean_score")
query("map_region_month", "SELECT p.region_id, ordinal, s.mean AS mean_score FROM panel p LEFT JOIN season s ON p.region_id = s.region_id AND p.month = s.month", lambda s, d: (lambda p: clim.with_lookup(p, clim.means(weekly.labelled(p), [R, "month"]), [R, "month"]).select(*KEY, "mean_score"))(panel(s, d)), "mean_score")
query("map_dict_fallback", "SELECT p.region_id, ordinal, coalesce(s.mean, m.mean, 0) AS x FROM panel p LEFT JOIN (SELECT region_id, month, avg(score) AS mean FROM " + SPLIT + " WHERE split = 'train' AND score IS NOT NULL GROUP BY 1, 2) s ON p.region_id = s.region_id AND p.month = s.month LEFT JOIN (SELECT region_id, avg(score) AS mean FROM " + SPLIT + " WHERE split = 'train' GROUP BY 1) m ON p.region_id = m.region_id", lambda s, d: (lambda p: clim.seasonal_mean(p, weekly.labelled(weekly.hide_last(p)), to="x").select(*KEY, "x"))(panel(s, d)), "x")
_WEEK = "((month - 1) * 31 + day) // 7"
query("map_week_fallback", f"SELECT p.region_id, ordinal, coalesce(s.mean, m.mean, 0) AS x FROM panel p LEFT JOIN (SELECT region_id, {_WEEK} AS week, avg(score) AS mean FROM labelled GROUP BY 1, 2) s ON p.region_id = s.region_id AND {_WEEK} = s.week LEFT JOIN means m ON p.region_id = m.region_id", lambda s, d: (lambda p: clim.seasonal_mean(p, weekly.labelled(p), "week", "x", "week").select(*KEY, "x"))(panel(s, d).withColumn("week", F.floor(((c("month") - 1) * 31 + c("day")) / 7))), "x")
query("join_region_stats", "SELECT w.region_id, ordinal, a AS region_mean, b AS region_median, e AS region_std FROM weekly w LEFT JOIN (SELECT region_id, avg(score) AS a, median(score) AS b, coalesce(stddev_samp(score), 0) AS e FROM panel GROUP BY 1) m ON w.region_id = m.region_id", lambda s, d: clim.with_lookup(weekly_rows(s, d), clim.region_statistics(panel(s, d)), [R]).select(*KEY, "region_mean", "region_median", "region_std"), "region_mean region_median region_std")


def _forecast(s: SparkSession, d: str, column: str = "b") -> DataFrame:
    p = predictions(s, d)
    return p.groupBy(R).agg(*(F.max(F.when(c("horizon") == k, c(column) * (1 + 0.1 * k))).alias(f"pred_week{k}") for k in range(1, 6)))


def _template(s: SparkSession, d: str) -> DataFrame:
    return s.range(30).select(c("id").alias(R))


_FORECAST = lambda x: f"(SELECT region_id, {', '.join(f'max({x} * (1 + 0.1 * {k})) FILTER (horizon = {k}) AS pred_week{k}' for k in range(1, 6))} FROM preds GROUP BY 1)"
_WEEKS = " ".join(f"pred_week{k}" for k in range(1, 6))
_TABLE = "SELECT t.region_id, " + ", ".join(f"coalesce(least(greatest(pred_week{k}, 0), 5), 0) AS pred_week{k}" for k in range(1, 6)) + f" FROM (SELECT CAST(range AS BIGINT) AS region_id FROM range(30)) t LEFT JOIN {_FORECAST('b')} f ON t.region_id = f.region_id"
query("join_template", _TABLE, lambda s, d: ev.forecast_table(_template(s, d), _forecast(s, d)), _WEEKS)


def _submission(s: SparkSession, d: str) -> DataFrame:
    """Forecasts as CSV in a template's order, read back."""
    path, template = scratch(s), _template(s, d).withColumn("place", 30 - c(R))
    table = ev.forecast_table(template, _forecast(s, d))
    files.write_submission(table, template, path)
    return s.read.option("header", True).schema(table.schema).csv(path)


query("snk_submission", _TABLE, _submission, _WEEKS)
query("reindex", "SELECT t.region_id, coalesce(mean, 0) AS x FROM (SELECT CAST(range AS BIGINT) AS region_id FROM range(30)) t LEFT JOIN means m ON t.region_id = m.region_id", lambda s, d: _template(s, d).join(clim.means(panel(s, d), [R]), [R], "left").select(R, F.coalesce("mean_score", F.lit(0.0)).alias("x")), "x")
query("anti_regions", "SELECT DISTINCT region_id FROM panel WHERE region_id NOT IN (SELECT region_id FROM panel GROUP BY 1 HAVING avg(score) > 0.5)", lambda s, d: (lambda p: p.select(R).distinct().join(clim.means(p, [R]).filter("mean_score > 0.5"), [R], "left_anti"))(panel(s, d)))
query("submission_diff", f"SELECT CAST(k AS BIGINT) AS horizon, avg(abs(x - y)) AS mean_abs_diff, corr(x, y) AS corr FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([{', '.join(f'a.pred_week{k}' for k in range(1, 6))}]) AS x, unnest([{', '.join(f'b.pred_week{k}' for k in range(1, 6))}]) AS y FROM {_FORECAST('b')} a JOIN {_FORECAST('c')} b ON a.region_id = b.region_id) GROUP BY 1", lambda s, d: ev.forecast_difference(_forecast(s, d, "b"), _forecast(s, d, "c")), "mean_abs_diff corr")

# sorts, limits and sets
query("sort_panel", f"SELECT {K}, prec FROM panel ORDER BY region_id, ordinal", lambda s, d: panel(s, d).select(*KEY, "prec").orderBy(*KEY), "prec")
query("head_tail", f"SELECT {K} FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ordinal DESC) AS nth FROM panel) WHERE nth <= 3", lambda s, d: weekly.last_rows(panel(s, d), [R], 3).select(*KEY))
query("argmax_region", "SELECT arg_max(region_id, mean) AS high, arg_min(region_id, mean) AS low FROM (SELECT region_id, avg(score) AS mean FROM panel GROUP BY 1)", lambda s, d: summaries.extreme_keys(clim.means(panel(s, d), [R]), R, "mean_score"))
query("union_panels", f"SELECT {K}, score FROM {SPLIT}", lambda s, d: (lambda p: weekly.union_panels(p.filter("split = 'train'"), p.filter("split = 'test'").drop("score")).select(*KEY, "score"))(weekly.hide_last(panel(s, d))), "score")
query("distinct_regions", "SELECT DISTINCT region_id FROM panel", lambda s, d: panel(s, d).select(R).distinct())
query("set_diff", "SELECT DISTINCT region_id FROM panel EXCEPT SELECT region_id FROM panel WHERE score >= 3", lambda s, d: (lambda p: p.select(R).subtract(p.filter("score >= 3").select(R)))(panel(s, d)))
query("unpivot_preds", f"SELECT region_id, unnest([1, 2, 3, 4, 5])::BIGINT AS week, unnest([{', '.join(f'pred_week{k}' for k in range(1, 6))}]) AS pred FROM {_FORECAST('b')}", lambda s, d: _forecast(s, d).unpivot([R], [f"pred_week{k}" for k in range(1, 6)], "w", "pred").select(R, F.substring("w", 10, 1).cast("long").alias("week"), "pred"), "pred")
query("dup_check", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", lambda s, d: summaries.duplicates(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]))
query("consistency_check", "SELECT count(*) FILTER (tmp_max < tmp_min) AS max_below_min, count(*) FILTER (tmp < tmp_min OR tmp > tmp_max) AS tmp_outside, count(*) FILTER (surf_pre < 80) AS low_pressure FROM panel", lambda s, d: summaries.consistency(panel(s, d), "surf_pre"))
query("calendar_gaps", "SELECT region_id, count(g) AS n_gaps, max(g) AS max_gap, avg(g) AS mean_gap FROM (SELECT region_id, CASE WHEN ordinal - lag(ordinal) OVER o > 1 THEN ordinal - lag(ordinal) OVER o END AS g FROM panel WINDOW o AS (PARTITION BY region_id ORDER BY ordinal)) GROUP BY 1", lambda s, d: summaries.calendar_gaps(panel(s, d)), "mean_gap")
query("label_gaps", "SELECT step, count(*) AS n FROM (SELECT ordinal - lag(ordinal) OVER (PARTITION BY region_id ORDER BY ordinal) AS step FROM labelled) WHERE step IS NOT NULL GROUP BY 1", lambda s, d: summaries.label_gaps(panel(s, d)))
