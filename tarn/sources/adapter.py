"""A panel from the order tables: regions are suppliers' nations, days are ship dates.

Every measure is a ratio of whole numbers, a minimum or a maximum, so engines agree on it whatever the order of summing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import ordinal

#: Measures that few queries read.
MORE = ("surf_pre", "dp_tmp", "surf_tmp")
MEASURES = ("prec", "tmp", "humidity", "wind", "tmp_min", "tmp_max", "tmp_range")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, year, month, day, ordinal, measures, and a score on one day of seven."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    date = F.col("l_shipdate")
    percent = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) * F.lit(1.0) / F.count("*")
    days = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").cast("long").alias("region_id"), F.year(date).cast("long").alias("year"), F.month(date).cast("long").alias("month"), F.day(date).cast("long").alias("day"))
        .agg(
            F.sum("l_quantity").alias("prec"), percent("l_discount").alias("tmp"), percent("l_tax").alias("humidity"), F.max("l_linenumber").cast("double").alias("wind"), F.min("l_extendedprice").alias("tmp_min"),
            F.max("l_extendedprice").alias("tmp_max"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_r"),
            F.max("l_quantity").alias("surf_pre"), F.min("l_quantity").alias("dp_tmp"), F.max("l_discount").alias("surf_tmp"),
        )
    )
    day = ordinal(F.col("year"), F.col("month"), F.col("day"))
    score = F.when(F.col("ordinal") % 7 == 3, F.least(F.lit(5), F.col("_r")).cast("double"))
    return days.withColumn("ordinal", day).select("region_id", "year", "month", "day", "ordinal", *MEASURES[:-1], (F.col("tmp_max") - F.col("tmp_min")).alias("tmp_range"), *MORE, score.alias("score"))


#: The same panel for other engines; `panel` is the name of the last table.
PANEL_SQL = """d AS (
  SELECT CAST(s_nationkey AS BIGINT) AS region_id, year(l_shipdate) AS year, month(l_shipdate) AS month, day(l_shipdate) AS day,
         sum(l_quantity) AS prec, min(l_extendedprice) AS tmp_min, max(l_extendedprice) AS tmp_max,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS tmp,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS humidity,
         CAST(max(l_linenumber) AS DOUBLE) AS wind, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
         max(l_quantity) AS surf_pre, min(l_quantity) AS dp_tmp, max(l_discount) AS surf_tmp
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
panel AS (
  SELECT region_id, year, month, day, year * 372 + month * 31 + day AS ordinal, prec, tmp, humidity, wind, tmp_min, tmp_max, tmp_max - tmp_min AS tmp_range, surf_pre, dp_tmp, surf_tmp,
         CASE WHEN (year * 372 + month * 31 + day) % 7 = 3 THEN CAST(least(5, r) AS DOUBLE) END AS score
  FROM d)"""
