"""Registration of queries with their SQL, and the tables that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import windows
from ..operators.weekly import labelled, to_weekly
from ..sources.adapter import PANEL_SQL, panel

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Tables of the SQL side, in the order in which they build on each other.
TABLES = f"""{PANEL_SQL},
labelled AS (SELECT * FROM panel WHERE score IS NOT NULL),
weekly AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY region_id, ordinal // 7 ORDER BY ordinal DESC) AS nth FROM labelled) WHERE nth = 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY region_id) AS n FROM weekly),
aimed AS (
  SELECT *, {", ".join(f"lead(score, {k}) OVER o AS y{k}" for k in range(1, 6))} FROM numbered WINDOW o AS (PARTITION BY region_id ORDER BY ordinal)),
windows AS (SELECT * FROM aimed WHERE i < n - 5),
means AS (SELECT region_id, avg(score) AS mean, median(score) AS med FROM panel GROUP BY region_id),
season AS (SELECT region_id, month, avg(score) AS mean FROM labelled GROUP BY region_id, month),
preds AS (
  SELECT w.region_id, w.i, CAST(k AS BIGINT) AS horizon, [y1, y2, y3, y4, y5][k] AS y, m.mean AS a, w.score AS b, s.mean AS c, m.med AS d,
         least(1.0, (w.score + m.mean) / 5) AS p
  FROM windows w JOIN means m ON w.region_id = m.region_id JOIN season s ON w.region_id = s.region_id AND w.month = s.month, (VALUES (1), (2), (3), (4), (5)) AS v(k)
  WHERE w.i = w.n - 6)"""


#: Added before rounding: means of whole numbers often end in exactly 5, where engines that sum in another order part.
SHIFT = 1e-9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, whole numbers as BIGINT, so that engines can be compared."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return (F.round(c.cast("double") + SHIFT, 6) + 0.0).alias(name)
        return c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c

    return df.select(*(one(n, k) for n, k in df.dtypes))


def query(name: str, sql: str | None, make: Callable[..., DataFrame], doubles: str = "", tables: str = TABLES) -> None:
    """Register `make`; `sql` selects from the tables, and its `doubles` (names) are rounded there too."""
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    if sql is not None:
        names = doubles.split()
        replace = f" REPLACE ({', '.join(f'round({n} + {SHIFT}, 6) + 0.0 AS {n}' for n in names)})" if names else ""
        SQL[name] = f"WITH {tables},\nresult AS (\n{sql})\nSELECT *{replace} FROM result" if tables else sql


def weekly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_weekly(labelled(panel(spark, sf_dir)))


def window_rows(spark: SparkSession, sf_dir: str, stride: int = 1) -> DataFrame:
    return windows(weekly_rows(spark, sf_dir), stride)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts without a model, for each region's last window: y, and a (the region's mean score), b (the last score), c
    (the mean of the region's month), d (the region's median) and p, a stand-in for P(score > 0)."""
    from ..operators.evaluation import long_form

    days = panel(spark, sf_dir)
    means = days.groupBy("region_id").agg(F.avg("score").alias("a"), F.median("score").alias("d"))
    season = labelled(days).groupBy("region_id", "month").agg(F.avg("score").alias("c"))
    last = window_rows(spark, sf_dir).filter(F.col("i") == F.col("n") - 6)
    w = last.join(means, ["region_id"]).join(season, ["region_id", "month"]).withColumn("b", F.col("score"))
    w = w.withColumn("p", F.least(F.lit(1.0), (F.col("score") + F.col("a")) / 5))
    return long_form(w, {c: [c] * 5 for c in "abcdp"})
