"""Lags and rolling statistics by rows of a region, in the order of days.

All frames share one window specification, so a select of any number of them plans as one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "region_id", "ordinal"

MinRows = Callable[[int], int]


def by_time(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def tenth(w: int) -> int:
    return max(3, w // 10)


def quarter(w: int) -> int:
    return max(3, w // 4)


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum, "median": lambda c: F.percentile(c, 0.5),
}


def roll(column: str | Column, stat: str, first: int, last: int, least: int) -> Column:
    """A statistic of the rows `first`..`last` from here (negative: before), null under `least` values."""
    c = F.col(column) if isinstance(column, str) else column
    frame = by_time().rowsBetween(first, last)
    return F.when(F.count(c).over(frame) >= least, AGGREGATES[stat](c).over(frame))


def prior(column: str | Column, stat: str, width: int, least: int) -> Column:
    """A statistic of the `width` rows before this one."""
    return roll(column, stat, -width, -1, least)


def lags(columns: Sequence[str], steps: Sequence[int]) -> list[Column]:
    return [F.lag(c, k).over(by_time()).alias(f"{c}_lag{k}") for c in columns for k in steps]


def prior_means_by_prefix(df: DataFrame, column: str, widths: Sequence[int], least: MinRows = tenth) -> DataFrame:
    """Prior means and deviations of many widths from running sums, whose cost does not grow with the widths.

    Sums of squares are taken about the region's mean, or they would cancel for large means.
    """
    o = by_time()
    whole = Window.partitionBy(KEY)
    run = o.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_x", F.col(column) - F.avg(column).over(whole)).withColumn("_m", F.avg(column).over(whole))
    d = d.select("*", F.coalesce(F.sum("_x").over(run), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(run), F.lit(0.0)).alias("_q"), F.count("_x").over(run).alias("_c"))
    out = []
    for w in widths:
        s, q, c = (F.col(n) - F.coalesce(F.lag(n, w).over(o), F.lit(0)) for n in ("_s", "_q", "_c"))
        ok = c >= least(w)
        out.append(F.when(ok, F.col("_m") + s / c).alias(f"{column}_roll{w}_mean"))
        out.append(F.when(ok & (c > 1), F.sqrt(F.greatest(q - s * s / c, F.lit(0.0)) / (c - 1))).alias(f"{column}_roll{w}_std"))
    return d.select(*df.columns, *out)


def ewm_prior(df: DataFrame, column: str, span: int, least: int, name: str) -> DataFrame:
    """Adds the exponentially weighted mean of all prior rows: weights (1 - 2 / (span + 1)) ** age, for spans over 1.

    Rows are summed in blocks in which weights fall to a millionth; three blocks back they are under 1e-17 of the newest
    value's. So the work for a row depends on neither span nor history. Nulls keep their places; after them the mean stays.
    """
    if span <= 1:
        raise ValueError("span must be over 1")
    keep = 1 - 2 / (span + 1)
    size = math.ceil(-6 * math.log(10) / math.log(keep))
    o = by_time()
    nth = F.row_number().over(o) - 1
    place = F.col("_place")
    d = df.withColumn("_nth", nth).withColumn("_block", F.floor(F.col("_nth") / size)).withColumn("_place", F.pmod("_nth", F.lit(size)).cast("double"))
    weight = F.when(F.col(column).isNotNull(), F.pow(F.lit(keep), -place))
    d = d.withColumns({"_w": weight, "_x": weight * F.col(column)})
    inside = Window.partitionBy(KEY, "_block").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(KEY).orderBy("_block")

    def total(c: str) -> Column:
        parts = [F.coalesce(F.sum(c).over(inside), F.lit(0.0)) * F.pow(F.lit(keep), place)]
        parts += [F.coalesce(F.sum(c).over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) * F.pow(F.lit(keep), place + k * size) for k in (1, 2, 3)]
        return sum(parts[1:], parts[0])

    after_value = F.lag(column).over(o).isNotNull()
    d = d.withColumns({"_mean": F.when(after_value, total("_x") / total("_w")), "_seen": F.count(column).over(o.rowsBetween(Window.unboundedPreceding, -1))})
    mean = F.last("_mean", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))
    return d.select(*df.columns, F.when(F.col("_seen") >= least, mean).alias(name))


def dry_days(df: DataFrame, column: str = "prec", widths: Sequence[tuple[int, int]] = ((14, 3), (30, 7)), limit: float = 1.0) -> DataFrame:
    dry = F.coalesce((F.lag(column, 1).over(by_time()) < limit).cast("double"), F.lit(0.0))
    return df.withColumn("_dry", dry).select(*df.columns, *(roll("_dry", "sum", 1 - w, 0, least).alias(f"dry_days_{w}d") for w, least in widths))


def forward_fill(column: str) -> Column:
    return F.last(column, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(column: str) -> Column:
    return F.first(column, ignorenulls=True).over(by_time().rowsBetween(0, Window.unboundedFollowing))


def fill_both(column: str) -> Column:
    return F.coalesce(forward_fill(column), backward_fill(column))


def neighbour_mean(column: str, width: int, place: str = "region_num") -> Column:
    """Mean over neighbouring regions of the same day."""
    half = width // 2
    return F.avg(column).over(Window.partitionBy(ORDER).orderBy(place).rowsBetween(-half, half))
