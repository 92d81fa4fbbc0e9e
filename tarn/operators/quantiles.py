"""Exact quantiles of whole tables without a task that sees all values.

A mergeable sketch bounds the rank that is sought; counts of what lies below the bounds make it certain, and only values between
them are counted one by one. While a range holds more than FEW rows of different values it is narrowed by a sketch of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range whose values are ranked in one task.
FEW = 100_000
#: Accuracy of a sketch: ranks are off by one in so many rows at most.
ACCURACY = 10_000


@dataclass
class _Range:
    """The values from `low` to `high`, one of which has the 0-based `rank`."""

    column: str
    rank: int
    low: float
    high: float
    below: int = 0
    rows: int = 0


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], few: int = FEW) -> dict[str, float | None]:
    """Each name's (column, share): the value at that share of the column's rows, linear between neighbours; null without rows.

    The columns are held (in memory, else on disk) while they are looked at, as what they come from may be dear.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    x = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns))).persist()
    try:
        return _quantiles(x, columns, wanted, few)
    finally:
        x.unpersist()


def _quantiles(x: DataFrame, columns: list[str], wanted: dict[str, tuple[str, float]], few: int) -> dict[str, float | None]:
    name = {c: f"x{i}" for i, c in enumerate(columns)}
    shares = {c: sorted({s for k, s in wanted.values() if k == c}) for c in columns}
    first = x.agg(*(v for c in columns for v in (F.count(name[c]), F.min(name[c]), F.max(name[c]), _sketch(F.col(name[c]), [b for s in shares[c] for b in _around(s, 2 / ACCURACY)])))).first()
    facts = {c: first[4 * i : 4 * i + 4] for i, c in enumerate(columns)}
    ranges: dict[tuple[str, int], _Range] = {}
    for c, s in wanted.values():
        n, low, high, bounds = facts[c]
        at = shares[c].index(s)
        for rank in {math.floor((n - 1) * s), math.ceil((n - 1) * s)} if n else ():
            ranges[c, rank] = _Range(name[c], rank, low if n <= few else bounds[2 * at], high if n <= few else bounds[2 * at + 1])
    if any(n > few for n, *_ in facts.values()):
        _narrow(x, list(ranges.values()), few)
    values = _pick(x, list(ranges.values()))
    out: dict[str, float | None] = {}
    for key, (c, s) in wanted.items():
        n = facts[c][0]
        if not n:
            out[key] = None
            continue
        place = (n - 1) * s
        a, b = values[name[c], math.floor(place)], values[name[c], math.ceil(place)]
        out[key] = a + (b - a) * (place - math.floor(place))
    return out


def _sketch(c: Column, shares: list[float]) -> Column:
    return F.percentile_approx(c, [min(max(s, 0.0), 1.0) for s in shares], ACCURACY)


def _around(share: float, slack: float) -> list[float]:
    return [share - slack, share + slack]


def _inside(r: _Range) -> Column:
    return F.col(r.column).between(r.low, r.high)


def _narrow(x: DataFrame, ranges: list[_Range], few: int) -> None:
    """Makes every range small, or one value; counts what lies below it."""
    todo = ranges
    while todo:
        counts = x.agg(*(v for r in todo for v in (F.count_if(F.col(r.column) < r.low), F.count_if(_inside(r))))).first()
        for i, r in enumerate(todo):
            r.below, r.rows = counts[2 * i], counts[2 * i + 1]
            if not r.below <= r.rank < r.below + r.rows:
                raise ArithmeticError("a sketch is less accurate than it says")
        todo = [r for r in todo if r.rows > few and r.low < r.high]
        if todo:
            bounds = x.agg(*(_sketch(F.when(_inside(r), F.col(r.column)), _around((r.rank - r.below) / r.rows, 2 / ACCURACY)) for r in todo)).first()
            for r, (low, high) in zip(todo, bounds, strict=True):
                todo = [t for t in todo if t is not r] if (low, high) == (r.low, r.high) else todo  # ties at both ends: few different values
                r.low, r.high = low, high


def _pick(x: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], float]:
    """The value of each range's rank: different values of all ranges are counted first, then ranked a range at a time."""
    if not ranges:
        return {}
    hits = F.array_compact(F.array(*(F.when(_inside(r), F.struct(F.lit(i).alias("i"), F.col(r.column).alias("v"))) for i, r in enumerate(ranges))))
    counted = x.select(F.explode(hits).alias("hit")).groupBy("hit.i", "hit.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    rank = F.array(*(F.lit(r.rank - r.below) for r in ranges))[F.col("i")]
    found = counted.withColumn("upto", upto).filter(F.col("upto") > rank).groupBy("i").agg(F.min("v").alias("v")).collect()  # a row for each range
    return {(ranges[r["i"]].column, ranges[r["i"]].rank): r["v"] for r in found}


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column for each quantile."""
    return df.sparkSession.createDataFrame([tuple(quantiles(df, wanted).values())], ", ".join(f"`{k}` double" for k in wanted))
