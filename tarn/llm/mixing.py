"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a shuffled order that depends on the rows alone. A document's virtual finish
time is its source's cumulative size divided by the source's target; a source that is to be repeated queues up a second
time behind itself. Serving all queues in the order of finish times, cut off at the total budget, takes from every source
in proportion to its target.

Scale: cumulative sizes come from per-(source, bucket) sums and windows inside the 4096 buckets of the shuffle
key, so a source with a third of all rows is split as others are. The global order is split the same way, into ranges
of the virtual clock; the range in which the budget runs out is split again until it has EDGE rows, and only those are ordered row
by row. What is taken is then, for each source and round, a threshold on the shuffle key and the row's place in the scan, which
parts rows that are equal: one row for each source. Up to FEW sources, counted before, are
broadcast, so texts don't cross a shuffle; more are joined over SPREAD parts of every source, so a hot source is no hot
task.

Defined results: a size is the number of runs of characters other than space and 09-0D; null texts and texts
without words have size 0 and are never taken; null is a source of its own, last in order; rows that
repeat both id and text are taken one by one, in the order in which they are scanned; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, folded

#: Hex digits of the shuffle key that make a bucket, and ranges of the virtual clock per unit of time.
DIGITS, TICKS = 3, 4096
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights that sources get in turn, in the code point order of their names.
WEIGHTS = (3.0, 1.0, 2.0)
#: No source is taken more often than this.
ROUNDS = 2
#: Parts over which rows of one source are dealt where they meet what is known of the source.
SPREAD = 32
#: Rows of a range of the clock that are ordered at once.
EDGE = 100_000
#: So many rows of sources are broadcast at most.
FEW = 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A key that orders rows at random, but the same way at every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sources: DataFrame, numerator: int, denominator: int, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """`sources` (source, source_size; one row each) with nth and target.

    The budget is numerator / denominator of all sizes. Targets share it by weight; no target exceeds ROUNDS times its
    source's size, and what that cuts off is shared among the others by weight: target = min(cap, level * weight), with
    the level found by going through the sources in the order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    named = sources.select("source", "source_size", nth.alias("nth"), weight.alias("weight"), (F.col("source_size") * ROUNDS).cast("double").alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(every).cast("double") * numerator / denominator
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if every source from here on stays below its cap; the first such source in order gives the true one
    leveled = named.withColumn("level", (budget - filled) / open_weight).withColumn("below", F.col("level") <= F.col("cap") / F.col("weight"))
    level = F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(every)["level"]
    return leveled.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("source", "source_size", "nth", "target")


def with_source(rows: DataFrame, per_source: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of their source's row in `per_source` (of, ...)."""
    if per_source.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    copies = per_source.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = rows.withColumn("__own", F.pmod(F.hash(key), F.lit(SPREAD)))
    return dealt.join(copies, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__own") == F.col("__part"))).drop("__of", "__own", "__part")


@dataclass
class Mix:
    """sized: doc_id, source, size, key and row of every row; sources: their sizes and targets; cuts: the last key and row taken."""

    sized: DataFrame
    sources: DataFrame
    cuts: DataFrame
    seed: int


def plan_mix(docs: DataFrame, numerator: int = 3, denominator: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: int = 2) -> Mix:
    text = F.col("text")
    sized = cut(docs.select("doc_id", "source", size_of(text).alias("size"), shuffle_key(F.col("doc_id"), text, seed).alias("key"), F.monotonically_increasing_id().alias("row")))
    bucketed = sized.withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    sources = cut(targets(per_source, numerator, denominator, weights))
    run = Window.partitionBy("source").orderBy("bucket")
    offsets = sums.select("source", "bucket", (F.sum("bucket_size").over(run) - F.col("bucket_size")).alias("ahead"))
    queued = _queue(bucketed.filter("size > 0"), offsets)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = queued.withColumn("served", F.col("ahead") + F.sum("size").over(inside)).select("source", "size", "key", "row", "served")
    t = sources.select(F.col("source").alias("__of"), "nth", "target", "source_size")
    queued = with_source(queued, t, "key")
    finish = F.explode(F.array(*(F.struct(F.lit(r).alias("round"), ((F.col("served") + F.col("source_size") * r) / F.col("target")).alias("finish")) for r in range(ROUNDS))))
    items = cut(queued.select("source", "nth", "size", "key", "row", finish.alias("f")).select("source", "nth", "size", "key", "row", "f.*"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    taken = _served(items, total * numerator, denominator)
    by_round = [F.max(F.when(F.col("round") == r, _place(F.col("key"), F.col("row")))).alias(f"cut{r}") for r in range(ROUNDS)]
    cuts = cut(taken.groupBy("source").agg(*by_round))
    return Mix(sized, sources, cuts, seed)


def _served(items: DataFrame, limit: int, denominator: int) -> DataFrame:
    """The items whose sizes, in the order of the clock, stay within limit / denominator.

    Sums by ranges of the clock tell the range in which the budget runs out; it is split into TICKS finer ones while it is long.
    """
    columns = ["source", "round", "key", "row"]
    edge, left, scale, taken = items, limit, TICKS, items.limit(0).select(columns)
    while True:
        tick = F.least(F.floor(F.col("finish") * scale), F.lit(1 << 60)).cast("long")
        by_tick = edge.groupBy(tick.alias("tick")).agg(F.sum("size").alias("tick_size"), F.count("*").alias("rows"))
        clock = by_tick.withColumn("done", F.sum("tick_size").over(Window.orderBy("tick")))  # a row for each range
        last = clock.filter(F.col("done") * denominator > left).orderBy("tick").limit(1).collect()
        if not last:
            return taken.union(edge.select(columns))
        taken = taken.union(edge.filter(tick < last[0]["tick"]).select(columns))
        left -= (last[0]["done"] - last[0]["tick_size"]) * denominator
        edge = edge.filter(tick == last[0]["tick"])
        if last[0]["rows"] <= EDGE or scale > 1 << 36:
            break
        scale *= TICKS
    edge = edge.withColumn("used", F.sum("size").over(Window.orderBy("finish", "nth", "round", "key", "row").rowsBetween(Window.unboundedPreceding, 0)))
    return taken.union(edge.filter(F.col("used") * denominator <= left).select(columns))


def _queue(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    o = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "ahead")
    return rows.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).drop("o_source", "o_bucket")


def _place(key: Column, row: Column) -> Column:
    return F.struct(key.alias("key"), row.alias("row"))


def _copies(size: Column, key: Column, row: Column) -> Column:
    times = [F.when((size > 0) & (_place(key, row) <= F.col(f"__cut{r}")), F.lit(1)).otherwise(F.lit(0)) for r in range(ROUNDS)]
    return sum(times[1:], times[0])


def mixed_sizes(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every row."""
    s = mix.sources.select(F.col("source").alias("__source"), "source_size", "target")
    c = mix.cuts.select(F.col("source").alias("__cut_source"), *(F.col(f"cut{r}").alias(f"__cut{r}") for r in range(ROUNDS)))
    per_source = s.join(c, F.col("__source").eqNullSafe(F.col("__cut_source")), "left")
    out = with_source(mix.sized, per_source.withColumnRenamed("__source", "__of"), "key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("size"), F.col("key"), F.col("row"))).alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of `docs` that the mix takes, as often as it takes them, with all their columns whatever their names.

    `docs` must be scanned in the order in which it was planned, as files are: equal rows are told apart by their place.
    """
    c = mix.cuts.select(F.col("source").alias("__of"), *(F.col(f"cut{r}").alias(f"__cut{r}") for r in range(ROUNDS)))
    slim, column = folded(docs, "doc_id", "source", "text")
    keyed = slim.withColumns({"__key": shuffle_key(F.col("doc_id"), F.col("text"), mix.seed), "__row": F.monotonically_increasing_id()})
    found = with_source(keyed, c, "__key")
    size = F.when(F.regexp_like(F.col("text"), F.lit(WORDS)), F.lit(1)).otherwise(F.lit(0))
    times = F.explode(F.sequence(F.lit(1), _copies(size, F.col("__key"), F.col("__row")).cast("int")))
    return found.filter(_copies(size, F.col("__key"), F.col("__row")) > 0).withColumn("__copy", times).select(*map(column, docs.columns))
