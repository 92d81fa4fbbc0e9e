"""Statistics of prior rows whose cost does not grow with the widths, over histories of any length.

Means, deviations and sums are differences of running sums (about the first value as a whole number, so whole numbers stay exact and
not even a last digit depends on later rows);
largest and smallest values of 2, 4, 8, ... rows are built by doubling, and two of them cover any width. All of it is lags and running
sums over one window: one exchange, one sort.

A region whose history is longer than CHUNK rows is cut into chunks of its calendar. Each chunk also gets the rows before it that its
frames reach back to, as copies that are left out of the result, so a region spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import KEY, ORDER, MinRows, tenth

#: Days of the calendar in a chunk, and rows of a region up to which it is one.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Prior:
    """A statistic of the `width` rows before each row, null under `least` values."""

    column: str
    stat: str
    width: int
    least: int
    name: str


def over_chunks(df: DataFrame, reach: int, build: Callable[[DataFrame], DataFrame], chunk: int = CHUNK) -> DataFrame:
    """`build(df)` for a `build` whose windows are by region and look back over `reach` rows at most.

    `build` must keep the columns that it gets. Where no region has more than `chunk` rows this is `build(df)` itself.
    """
    top = df.groupBy(KEY).count().agg(F.max("count")).first()[0]
    if (top or 0) <= chunk:
        return build(df)
    place = F.floor(F.col(ORDER) / chunk)
    counted = df.groupBy(F.col(KEY).alias("__key"), place.alias("__place")).agg(F.count("*").alias("__rows"))
    o = Window.partitionBy("__key").orderBy("__place")
    marks = counted.select("__key", "__place", F.row_number().over(o).alias("__nth"), (F.row_number().over(o) + 1).alias("__next"), F.sum("__rows").over(o).alias("__upto"), F.lead("__place").over(o).isNull().alias("__end"))
    # a chunk's rows are needed by every later one that begins less than `reach` rows after its end
    near = Window.partitionBy("__key").orderBy("__upto").rangeBetween(0, reach - 1)
    last = F.coalesce(F.max(F.when(~F.col("__end"), F.col("__next"))).over(near), F.col("__nth"))
    marks = marks.select("__key", "__place", "__nth", last.alias("__last"))
    joined = df.withColumn("__at", place).join(marks, F.col(KEY).eqNullSafe(F.col("__key")) & F.col("__at").eqNullSafe(F.col("__place")))
    spread = joined.withColumn("__target", F.explode(F.sequence("__nth", "__last"))).withColumn("__own", F.col("__target") == F.col("__nth"))
    parted = spread.select(*(F.struct(F.col(KEY).alias("key"), "__target").alias(KEY) if c == KEY else F.col(f"`{c}`") for c in df.columns), "__own")
    out = build(parted).filter("__own").drop("__own")
    return out.withColumn(KEY, F.col(KEY)["key"])


def with_priors(df: DataFrame, wanted: Sequence[Prior]) -> DataFrame:
    """`df` with all statistics, by running sums and doubling; `median` takes a frame of its own.

    The columns are SQL text: hundreds of them would take seconds to build call by call.
    """
    w = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER})"
    run = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    value = {p.column: f"CAST(`{p.column}` AS DOUBLE)" for p in wanted}
    sums = dict.fromkeys(p.column for p in wanted if p.stat != "median")
    squares = dict.fromkeys(p.column for p in wanted if p.stat == "std")
    whole = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    d = df.selectExpr("*", *(f"round(first({value[c]}, true) {whole}) AS `__m_{c}`" for c in sums))
    off = {c: f"({value[c]} - `__m_{c}`)" for c in sums}
    running = [f"coalesce(sum({off[c]}) {run}, 0.0D) AS `__s_{c}`" for c in sums] + [f"count({value[c]}) {run} AS `__c_{c}`" for c in sums]
    d = d.selectExpr("*", *running, *(f"coalesce(sum({off[c]} * {off[c]}) {run}, 0.0D) AS `__q_{c}`" for c in squares))
    best = {"max": "greatest", "min": "least"}
    extremes = [(s, c) for s in best for c in dict.fromkeys(p.column for p in wanted if p.stat == s)]
    widest = max((p.width for p in wanted if p.stat in best), default=1)
    level = lambda s, c, k: f"`__{s}{k}_{c}`" if k else value[c]
    for k in range(1, widest.bit_length()):
        d = d.selectExpr("*", *(f"{best[s]}({level(s, c, k - 1)}, lag({level(s, c, k - 1)}, {1 << (k - 1)}) {w}) AS `__{s}{k}_{c}`" for s, c in extremes))

    def one(p: Prior) -> str:
        if p.stat == "median":
            frame = f"OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN {p.width} PRECEDING AND 1 PRECEDING)"
            return f"CASE WHEN count({value[p.column]}) {frame} >= {p.least} THEN percentile({value[p.column]}, 0.5) {frame} END AS `{p.name}`"
        back = lambda n: f"(`__{n}_{p.column}` - lag(`__{n}_{p.column}`, {p.width}, 0) {w})"
        n, s, m = back("c"), back("s"), f"`__m_{p.column}`"
        if p.stat in best:
            k = p.width.bit_length() - 1
            x = f"{best[p.stat]}({', '.join(f'lag({level(p.stat, p.column, k)}, {j}) {w}' for j in (1, 1 + p.width - (1 << k)))})"
        elif p.stat == "std":
            x = f"CASE WHEN {n} > 1 THEN sqrt(greatest({back('q')} - {s} * {s} / {n}, 0.0D) / ({n} - 1)) END"
        else:
            x = f"{m} * {n} + {s}" if p.stat == "sum" else f"{m} + {s} / {n}"
        return f"CASE WHEN {n} >= {p.least} THEN {x} END AS `{p.name}`"

    return d.selectExpr(*(f"`{c}`" for c in df.columns), *map(one, wanted))


def with_prior_stats(df: DataFrame, columns: Sequence[str], widths: Sequence[int], stats: Sequence[str], least: MinRows = tenth, chunk: int = CHUNK) -> DataFrame:
    """Adds <column>_roll<width>_<stat> of prior rows."""
    wanted = [Prior(c, s, w, least(w), f"{c}_roll{w}_{s}") for c in columns for w in widths for s in stats]
    return over_chunks(df, max(widths), lambda d: with_priors(d, wanted), chunk)
