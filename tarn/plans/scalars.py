"""Queries of sources, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import measures as ms
from ..operators import features, rolling, summaries, weekly
from ..sources import files
from ..sources.adapter import panel
from ..sources.shared import fresh_folder
from .base import query, weekly_rows

KEY = ["region_id", "ordinal"]
K = "region_id, ordinal"
MINI = ("prec", "tmp", "humidity")


def scratch(spark: SparkSession) -> str:
    """A folder for a query that writes and reads back, in the session's shared one."""
    return fresh_folder(spark)


def _csv_round_trip(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    path = scratch(spark)
    days = panel(spark, sf_dir)
    text = days.select(F.concat(F.lit("R"), "region_id").alias("region_id"), cal.join_date(F.col("year"), F.col("month"), F.col("day")).alias("date"), *MINI, "score")
    text.write.option("header", True).csv(path)
    return files.read_panel_csv(spark, path, MINI, rows=rows).select("region_id", "date", "year", "month", "day", "ordinal", *MINI, "score")


_CSV = f"SELECT 'R' || region_id AS region_id, printf('%04d-%02d-%02d', year, month, day) AS date, year, month, day, ordinal, {', '.join(MINI)}, score FROM panel"
query("src_csv", _CSV, _csv_round_trip, "prec tmp humidity score")


def _quick_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda rows, name: _csv_round_trip(spark, sf_dir, rows).agg(F.count("*").alias(name), F.count("prec").alias(f"{name}_values"))
    return count(None, "n").crossJoin(count(1000, "quick"))


query("src_csv_pyarrow", "SELECT count(*) AS n, count(prec) AS n_values, least(count(*), 1000) AS quick, least(count(prec), 1000) AS quick_values FROM panel", _quick_csv)


def _parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    days = panel(spark, sf_dir)
    files.write_panel_parquet(days.filter("year < 1998"), path, append=True)
    files.write_panel_parquet(days.filter("year >= 1998"), path, append=True)
    return files.read_panel_parquet(spark, path, ["region_id", "ordinal", "prec", "score"])


query("src_parquet", f"SELECT {K}, prec, score FROM panel", _parquet_round_trip, "prec score")
query("snk_parquet_append", "SELECT region_id, count(*) AS n FROM panel GROUP BY region_id", lambda s, d: _parquet_round_trip(s, d).groupBy("region_id").agg(F.count("*").alias("n")))
query("src_columns", f"SELECT {K}, prec FROM panel", lambda s, d: panel(s, d).select(*KEY, "prec"), "prec")
query("src_parquet_meta", "SELECT count(*) AS n FROM lineitem", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").agg(F.count("*").alias("n")))


_CODED = ", dense_rank() OVER (ORDER BY region_id) - 1 AS region_code"


def _npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written, read back and coded again."""
    path = scratch(spark)
    days = panel(spark, sf_dir).withColumn("region_id", F.concat(F.lit("R"), "region_id"))
    files.write_panel_npz(days, path, ["prec"], rows=500)
    found = files.read_panel_npz(spark, path, ["prec"]).withColumn("region_id", F.substring("region_id", 2, 20).cast("long"))
    return files.encode_regions(found).select(F.concat(F.lit("R"), "region_id").alias("name"), "region_code", "ordinal", "prec")


query("src_npz", f"SELECT 'R' || region_id AS name{_CODED}, ordinal, prec FROM panel", _npz_round_trip, "prec")


def _npz_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_panel_npz(panel(spark, sf_dir), path, ["wind", "score"])
    return files.read_panel_npz(spark, path, ["wind", "score"]).withColumn("region_id", F.col("region_id").cast("long")).select("region_id", "year", "month", "day", "wind", "score")


query("snk_npz", "SELECT region_id, year, month, day, wind, score FROM panel", _npz_archives, "wind score")


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint replaced by a whole one."""
    path = scratch(spark)
    coded = files.encode_regions(panel(spark, sf_dir)).select("region_id", "region_code", "year", "month", "day", "wind")
    files.write_atomic(coded.limit(1), path)
    files.write_atomic(coded, path)
    return files.read_panel_parquet(spark, path)


query("ckpt_atomic", f"SELECT region_id{_CODED}, year, month, day, wind FROM panel", _replaced, "wind")


def _template_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission template of zeros as an archive, read back."""
    path = scratch(spark)
    zeros = panel(spark, sf_dir).select("region_id").distinct().select("region_id", *(F.lit(0.0).alias(w) for w in _WEEKS))
    files.write_panel_npz(zeros, path, _WEEKS)
    return files.read_regions_npz(spark, path, _WEEKS).withColumn("region_id", F.col("region_id").cast("long"))


_WEEKS = [f"pred_week{k}" for k in range(1, 6)]
query("snk_sub_npz", f"SELECT DISTINCT region_id, {', '.join(f'0.0::DOUBLE AS {w}' for w in _WEEKS)} FROM panel", _template_file, " ".join(_WEEKS))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    days = panel(spark, sf_dir).select(*KEY, "prec")
    days.filter("year < 1998").write.parquet(f"{root}/a")
    days.filter("year >= 1998").write.parquet(f"{root}/b/c")
    return files.find_panels(spark, root)


query("src_find", f"SELECT {K}, prec FROM panel", _found, "prec")
query("fx_small", f"SELECT {K}, prec FROM panel WHERE region_id IN (SELECT DISTINCT region_id FROM panel ORDER BY 1 LIMIT 3)", lambda s, d: summaries.first_regions(panel(s, d), 3).select(*KEY, "prec"), "prec")
query("fx_synth", None, lambda s, d: files.synthetic_panel(s, 2, 100))


def _reused(s: SparkSession, d: str) -> DataFrame:
    """The second call reads what the first one stored: its own rows would be none."""
    root, rows = scratch(s), panel(s, d).select(*KEY, "prec")
    files.load_or_compute(s, root, ["prec"], lambda: rows)
    return files.load_or_compute(s, root, ["prec"], lambda: rows.limit(0))


query("ckpt", f"SELECT {K}, prec FROM panel", _reused, "prec")

# dates
_DATE = "printf('%04d-%02d-%02d', year, month, day)"
query("date_join", f"SELECT {K}, {_DATE} AS date FROM panel", lambda s, d: panel(s, d).select(*KEY, cal.join_date(F.col("year"), F.col("month"), F.col("day")).alias("date")))


def _split(s: SparkSession, d: str) -> DataFrame:
    made = panel(s, d).select(*KEY, cal.join_date(F.col("year"), F.col("month"), F.col("day")).alias("date"))
    return made.withColumn("_d", cal.split_date(F.col("date"))).select(*KEY, "_d.year", "_d.month", "_d.day")


query("date_split", f"SELECT {K}, year, month, day FROM panel", _split)


def _project(name: str, sql: str, column, to: str = "x", double: bool = False) -> None:
    query(name, f"SELECT {K}, {sql} AS {to} FROM panel", lambda s, d: panel(s, d).select(*KEY, column().alias(to)), to if double else "")


def c(name: str):
    return F.col(name)


_project("ordinal", "year * 372 + month * 31 + day", lambda: cal.ordinal(c("year"), c("month"), c("day")))
_project("doy", "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][month] + day", lambda: cal.day_of_year(c("month"), c("day")))
_project("month_from_ordinal", "CASE (ordinal % 372) // 31 WHEN 0 THEN 12 ELSE (ordinal % 372) // 31 END", lambda: cal.month_of(c("ordinal")))
_project("month_from_ordinal_raw", "least(greatest((ordinal % 372) // 31, 0), 11)", lambda: cal.month_of_raw(c("ordinal")))
_project("week_of_year_ord", "(ordinal // 7) % 52", lambda: cal.week_of_year(c("ordinal")))
_project("week_of_year_cal", "((month - 1) * 31 + day) // 7", lambda: cal.calendar_week(c("month"), c("day")))
query("future_month", f"SELECT {K}, " + ", ".join(f"((((month - 1) * 31 + day + {7 * k}) - 1) // 31) % 12 + 1 AS m{k}" for k in range(1, 6)) + " FROM panel", lambda s, d: panel(s, d).select(*KEY, *(cal.future_month(c("month"), c("day"), k).alias(f"m{k}") for k in range(1, 6))))


def _cyclic(s: SparkSession, d: str, x: str, period: int) -> DataFrame:
    value = cal.week_of_year(c("ordinal")) if x == "week" else c(x)
    sin, cos = cal.cyclic(value, period)
    return panel(s, d).select(*KEY, sin.alias("s"), cos.alias("c"))


for _x, _p, _e in (("month", 12, "month"), ("day", 31, "day"), ("week", 52, "((ordinal // 7) % 52)")):
    query(f"cyc_{_x}", f"SELECT {K}, sin(2 * pi() * {_e} / {_p}) AS s, cos(2 * pi() * {_e} / {_p}) AS c FROM panel", lambda s, d, x=_x, p=_p: _cyclic(s, d, x, p), "s c")

_project("year_norm", "(year - 2000) / 20.0::DOUBLE", lambda: (c("year") - 2000) / 20.0, double=True)
query("global_year_norm", f"SELECT {K}, (ordinal - min(ordinal) OVER ())::DOUBLE / greatest(max(ordinal) OVER () - min(ordinal) OVER (), 1) AS global_year_norm FROM panel", lambda s, d: summaries.year_span(panel(s, d)).select(*KEY, "global_year_norm"), "global_year_norm")
query("spreads", f"SELECT {K}, tmp_max - tmp_min AS t, surf_tmp - tmp AS s, wind - 1 AS w FROM panel", lambda s, d: panel(s, d).select(*KEY, (c("tmp_max") - c("tmp_min")).alias("t"), (c("surf_tmp") - c("tmp")).alias("s"), (c("wind") - 1).alias("w")), "t s w")
_project("storm_proxy", "wind * prec", lambda: c("wind") * c("prec"), double=True)
_project("vpd_magnus", "CASE WHEN tmp IS NOT NULL AND humidity IS NOT NULL THEN greatest(6.112 * exp(17.67 * tmp / (tmp + 243.5)) * (1 - humidity / 100), 0.0) END", lambda: ms.vpd_magnus(c("tmp"), c("humidity")), double=True)


def _over(name: str, sql: str, columns, doubles: str) -> None:
    """Window expressions; in `sql`, o is the order of a region's days."""
    query(name, f"SELECT {K}, {sql} FROM panel WINDOW o AS (PARTITION BY region_id ORDER BY ordinal)", lambda s, d: panel(s, d).select(*KEY, *columns()), doubles)


def agg(f: str, x: str, first: int, last: int, least: int, table: str = "o") -> str:
    """A guarded rolling aggregate in SQL."""
    side = lambda n: f"{-n} PRECEDING" if n < 0 else "CURRENT ROW" if n == 0 else f"{n} FOLLOWING"
    w = f"OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN {side(first)} AND {side(last)})"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {f}({x}) {w} END"


_over("vpd_tetens", "0.6108 * exp(17.27 * lag(tmp) OVER o / (lag(tmp) OVER o + 237.3)) * (1 - lag(humidity) OVER o / 100) AS x", lambda: [ms.vpd_tetens(F.lag("tmp").over(rolling.by_time()), F.lag("humidity").over(rolling.by_time())).alias("x")], "x")
_aet = "(SELECT *, lag(tmp) OVER o * lag(wind) OVER o / (lag(humidity) OVER o + 1) AS aet FROM panel WINDOW o AS (PARTITION BY region_id ORDER BY ordinal))"


def _aet_query(s: SparkSession, d: str) -> DataFrame:
    w = rolling.by_time()
    made = panel(s, d).withColumn("aet", ms.aet_proxy(F.lag("tmp").over(w), F.lag("wind").over(w), F.lag("humidity").over(w)))
    return made.select(*KEY, rolling.roll("aet", "mean", -29, 0, 7).alias("x"))


query("aet_proxy", f"SELECT {K}, {agg('avg', 'aet', -29, 0, 7)} AS x FROM {_aet}", _aet_query, "x")


def _dryness(s: SparkSession, d: str) -> DataFrame:
    made = panel(s, d).withColumn("dryness", c("tmp") - c("dp_tmp"))
    w = rolling.by_time()
    return made.select(*KEY, "dryness", *(rolling.prior("dryness", "mean", n, k).alias(f"r{n}") for n, k in ((7, 3), (30, 5), (90, 14))), *(F.lag("dryness", k).over(w).alias(f"l{k}") for k in (7, 21)))


query("air_dryness", f"SELECT {K}, dryness, " + ", ".join(f"{agg('avg', 'dryness', -n, -1, k)} AS r{n}" for n, k in ((7, 3), (30, 5), (90, 14))) + ", lag(dryness, 7) OVER o AS l7, lag(dryness, 21) OVER o AS l21 FROM (SELECT *, tmp - dp_tmp AS dryness FROM panel) WINDOW o AS (PARTITION BY region_id ORDER BY ordinal)", _dryness, "dryness r7 r30 r90 l7 l21")

# values and rows
query("coerce_score", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS x FROM events", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", ms.coerce(F.when(c("event_id") % 3 == 0, F.lit("n/a")).otherwise(c("event_id").cast("string"))).alias("x")), "x", tables="events_ AS (SELECT 1)")
query("filter_labelled", f"SELECT {K}, score FROM labelled", lambda s, d: weekly.labelled(panel(s, d)).select(*KEY, "score"), "score")
query("filter_recent", f"SELECT {K}, score FROM (SELECT *, max(ordinal) OVER (PARTITION BY region_id) AS last FROM weekly) WHERE ordinal >= last - 3 * 372", lambda s, d: weekly.recent(weekly_rows(s, d), 3).select(*KEY, "score"), "score")
query("filter_recent_global", f"SELECT {K}, score FROM weekly WHERE ordinal >= 743000", lambda s, d: weekly.since(weekly_rows(s, d), 743000).select(*KEY, "score"), "score")
query("filter_regions", f"SELECT {K} FROM weekly WHERE region_id NOT IN (SELECT DISTINCT region_id FROM panel ORDER BY 1 LIMIT 3)", lambda s, d: (lambda w: w.join(w.select("region_id").distinct().orderBy("region_id").limit(3), ["region_id"], "left_anti").select(*KEY))(weekly_rows(s, d)))
query("filter_min_rows", f"SELECT {K} FROM numbered WHERE n >= 90", lambda s, d: weekly.at_least_rows(weekly_rows(s, d), 90).select(*KEY))
_Q = ("prec", "wind", "tmp")
query("clip_quantile", "SELECT p.region_id, p.ordinal, " + ", ".join(f"least(greatest({x}, {x}_q[1]), {x}_q[2]) AS {x}" for x in _Q) + " FROM panel p JOIN (SELECT region_id, " + ", ".join(f"quantile_cont({x}, [0.01, 0.99]) AS {x}_q" for x in _Q) + " FROM panel GROUP BY region_id) e ON p.region_id = e.region_id", lambda s, d: summaries.clip_to_quantiles(panel(s, d), _Q).select(*KEY, *_Q), " ".join(_Q))
_project("clip_score", "least(greatest(tmp - 2, 0), 5)", lambda: ms.clip_score(c("tmp") - 2), double=True)
_W = "CASE WHEN score >= 3 THEN {2} WHEN score >= 2 THEN {1} WHEN score >= 1 THEN {0} ELSE 1.0 END::DOUBLE"
query("sample_weight", f"SELECT {K}, {_W.format(1.3, 1.2, 1.1)} AS w FROM labelled", lambda s, d: weekly.labelled(panel(s, d)).select(*KEY, ms.band_weight(c("score")).alias("w")), "w")
query("sample_weight_v30", f"SELECT {K}, {_W.format(2.0, 1.5, 1.2)} AS w FROM labelled", lambda s, d: weekly.labelled(panel(s, d)).select(*KEY, ms.band_weight(c("score"), ms.BAND_WEIGHTS_STRONG).alias("w")), "w")
query("l1_weight", f"SELECT {K}, least(greatest(1 + score / 2.5, 1), 3) AS w FROM labelled", lambda s, d: weekly.labelled(panel(s, d)).select(*KEY, ms.linear_weight(c("score")).alias("w")), "w")
query("binarise", f"SELECT {K}, CAST(score > 0 AS BIGINT) AS x FROM labelled", lambda s, d: weekly.labelled(panel(s, d)).select(*KEY, (c("score") > 0).cast("long").alias("x")))
query("ensure_features", f"SELECT {K}, prec, 0.0::DOUBLE AS surf_pre FROM panel", lambda s, d: features.ensure_features(panel(s, d).select(*KEY, "prec"), ["prec", "surf_pre"]), "prec surf_pre")
query("select_dtypes", "SELECT l_discount, l_extendedprice, l_quantity, l_tax FROM lineitem", lambda s, d: (lambda t: t.select(*sorted(n for n, k in t.dtypes if k == "double")))(s.read.parquet(f"{d}/lineitem.parquet")), "l_discount l_extendedprice l_quantity l_tax")
query("region_num", "SELECT DISTINCT region_id, CAST(regexp_extract('R' || region_id, '([0-9]+)', 1) AS BIGINT) AS num FROM panel", lambda s, d: panel(s, d).select("region_id", F.regexp_extract(F.concat(F.lit("R"), "region_id"), "([0-9]+)", 1).cast("long").alias("num")).distinct())
query("strip_id", "SELECT DISTINCT trim(' R' || region_id || ' ') AS id FROM panel", lambda s, d: panel(s, d).select(F.trim(F.concat(F.lit(" R"), c("region_id").cast("string"), F.lit(" "))).alias("id")).distinct())
query("fill_ffill_bfill", f"SELECT {K}, coalesce(last_value(score IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(score IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS score FROM panel", lambda s, d: panel(s, d).select(*KEY, rolling.fill_both("score").alias("score")), "score")
query("fill_zero", f"SELECT {K}, coalesce(score, 0) AS score FROM panel", lambda s, d: panel(s, d).select(*KEY, F.coalesce("score", F.lit(0.0)).alias("score")), "score")
query("semi_regions", "SELECT DISTINCT region_id FROM labelled WHERE region_id IN (SELECT region_id FROM panel WHERE score IS NULL)", lambda s, d: (lambda p: weekly.labelled(p).select("region_id").distinct().join(p.filter("score is null"), ["region_id"], "left_semi"))(panel(s, d)))
