"""Sequences of weekly rows as arrays, for models that read several weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "region_id", "ordinal"


def _row(columns: Sequence[str]) -> Column:
    return F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in columns))


def _zeros(columns: Sequence[str], n: Column) -> Column:
    return F.array_repeat(F.array(*(F.lit(0.0) for _ in columns)), n)


def full(weekly: DataFrame, columns: Sequence[str], length: int = 13, horizons: int = 5) -> DataFrame:
    """seq: the `length` rows up to here; y1..: the scores after them. Rows without all of both are left out."""
    o = Window.partitionBy(KEY).orderBy(ORDER)
    seq = F.collect_list(F.array(*map(F.col, columns))).over(o.rowsBetween(1 - length, 0))
    aimed = weekly.select(KEY, ORDER, seq.alias("seq"), *(F.lead("score", k).over(o).alias(f"y{k}") for k in range(1, horizons + 1)))
    ys = [F.col(f"y{k}").isNotNull() for k in range(1, horizons + 1)]
    some = ys[0]
    for y in ys[1:]:
        some = some & y
    return aimed.filter((F.size("seq") == length) & some)


def zero_padded(weekly: DataFrame, columns: Sequence[str], length: int = 26) -> DataFrame:
    """The `length` rows up to here, with rows of zeros in front where history is short."""
    o = Window.partitionBy(KEY).orderBy(ORDER)
    got = weekly.select(KEY, ORDER, F.collect_list(_row(columns)).over(o.rowsBetween(1 - length, 0)).alias("_got"))
    return got.select(KEY, ORDER, F.concat(_zeros(columns, F.lit(length) - F.size("_got")), "_got").alias("seq"))


def last_repeat_padded(weekly: DataFrame, columns: Sequence[str], template: DataFrame, length: int = 13) -> DataFrame:
    """For every region of `template`, its last rows, the first of them repeated in front; zeros if it has none."""
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(ORDER)))
    tail = weekly.withColumn("_nth", rank).filter(F.col("_nth") <= length)
    got = tail.groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct(ORDER, _row(columns).alias("row")))), lambda r: r["row"]).alias("_got"))
    padded = F.concat(F.array_repeat(F.element_at("_got", 1), F.lit(length) - F.size("_got")), "_got")
    return template.select(KEY).distinct().join(got, [KEY], "left").select(KEY, F.coalesce(padded, _zeros(columns, F.lit(length))).alias("seq"))


def scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Adds <column>_scaled: z-scores by mean and population deviation of `fit_on`, the deviation not below the floor."""
    stats = fit_on.agg(*(x for c in columns for x in (F.avg(c).alias(f"_{c}_m"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_{c}_s"))))
    return df.join(F.broadcast(stats)).select(*df.columns, *(((F.col(c) - F.col(f"_{c}_m")) / F.col(f"_{c}_s")).alias(f"{c}_scaled") for c in columns))
