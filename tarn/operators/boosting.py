"""Gradient boosting on histograms: all models of a call grow in lockstep over one set of binned blocks.

Rows are binned once, into blocks of a few thousand rows, and stay in the executors. A pass over the blocks sums, for every
model at once, the histograms of the nodes whose split is not known; a shuffle by model and node adds the partitions' histograms
(in two steps where there are many partitions) and finds each node's split, so the driver sees splits only, whose number depends on
the trees and not on the rows. A tree that grows leaf by leaf takes as many passes as it is deep: a pass also asks for the children of
all leaves that would be split next if nothing better came, and the queue of gains then takes them strictly in order.

Bins follow weighted quantiles from mergeable summaries: exact while a feature has at most SUMMARY distinct values in a
partition. Rows and columns are drawn by hashes of row, seed and tree, so a task that runs again draws the same ones.

Defined results: missing features (null or NaN) are a bin of their own; rows without a target or of weight 0 do not count; a model
without rows predicts 0; categories beyond MOST_CATEGORIES share hashed codes; a category that was not seen goes right.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .trees import LEAF, Binning, Params, Split, Tree, best_shared_split, best_split, histogram, totals, weight

# fixed values: the published settings of the families
PUBLISHED = {
    "lgb": Params("leaf", "squared", 1500, 0.03, leaves=127, depth=0, least_rows=60, l1=0.1, l2=0.1, columns=0.8, category=True),
    "xgb": Params("level", "squared", 1500, 0.03, depth=6, least_hessian=50.0, l1=0.1, l2=1.0, rows=0.8, columns=0.8),
    "cat": Params("symmetric", "absolute", 1500, 0.03, depth=6, l2=3.0, bins=254),
    "l1": Params("leaf", "absolute", 1500, 0.03, leaves=31, depth=0, least_rows=50, rows=0.8, columns=0.8),
}
#: Distinct values of a feature that a partition's summary keeps.
SUMMARY = 2048
MOST_CATEGORIES = 10_000
#: Bytes of histograms that one pass holds in a task.
PASS_BYTES = 192 << 20
#: Trees after which the blocks take the predictions so far, and partitions whose histograms are added in one step.
REFRESH, FAN_IN = 25, 32
#: Cells of a residual histogram; two rounds find a median to 2e-6.
CELLS = 4096
#: A residual this near to 0 has no sign: medians are no finer.
NOUGHT = 1e-5

BLOCK = "bins binary, category binary, y binary, w binary, held binary, key binary, pred binary, n long"
FOUND = "job int, node int, gain double, feature int, bin int, missing_left boolean, categories array<int>, l array<double>, r array<double>, whole array<double>"


@dataclass(frozen=True)
class Job:
    """One model: which target it learns, its seed and settings."""

    target: int
    seed: int
    params: Params


@dataclass
class Boosted:
    """Trained models, one for each job."""

    names: list[str]
    category: str | None
    binning: Binning
    codes: dict[str, int] | None
    jobs: list[Job]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    errors: list[list[float]] = field(default_factory=list)  # of held rows, after 0, 1, ... trees

    def predict(self, df: DataFrame, to: str = "predictions") -> DataFrame:
        """Adds an array with each job's prediction."""
        x = F.array(*(F.col(f"`{n}`").cast("double") for n in self.names))
        model = self

        @F.arrow_udf("array<double>")
        def predicted(x: pa.Array, names: pa.Array) -> pa.Array:
            bins, category = model.binning.codes(_matrix(x, len(model.names))), _coded(names, model.codes, model.binning.categories)
            out = np.stack([b + j.params.rate * sum((t.values(bins, category) for t in trees), np.zeros(len(bins))) for b, j, trees in zip(model.base, model.jobs, model.trees, strict=True)], axis=1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return df.withColumn(to, predicted(x, _category(self.category)))

    def importances(self) -> np.ndarray:
        """jobs x features: gain of all splits; a category's splits are left out."""
        out = np.zeros((len(self.jobs), len(self.names)))
        for j, trees in enumerate(self.trees):
            for t in trees:
                for f, g in zip(t.feature, t.gain, strict=True):
                    if f >= 0:
                        out[j, f] += g
        return out


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), width)


def _category(name: str | None) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name else F.lit("")


def _hashed(values: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(v.encode()) % MOST_CATEGORIES for v in values.to_pylist()], np.int32)


def _coded(names: pa.Array, codes: dict[str, int] | None, categories: int) -> np.ndarray:
    if not categories:
        return np.zeros(len(names), np.int32)
    d = names.dictionary_encode()
    known = _hashed(d.dictionary) if codes is None else np.array([codes.get(v, -1) for v in d.dictionary.to_pylist()], np.int32)
    return known[d.indices.to_numpy()]


# bins


def _merged(values: np.ndarray, weights: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; beyond `keep` of them neighbours are joined to shares of equal weight."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    if len(values) <= keep:
        return values, weights
    share = np.minimum((np.cumsum(weights) - weights / 2) / weights.sum() * keep, keep - 1).astype(int)
    last = np.flatnonzero(np.append(np.diff(share) > 0, True))
    return values[last], np.bincount(share, weights, keep)[share[last]]


def edges_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of at most `bins` bins of nearly equal weight; between all values where these are few enough."""
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    cum = np.cumsum(weights)
    at = np.unique(np.searchsorted(cum, cum[-1] * np.arange(1, bins) / bins))
    return values[at[at < len(values) - 1]]


def find_edges(ready: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Edges of every feature from the partitions' weighted summaries, merged a feature at a time."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0))] * features
        for batch in batches:
            x, w = _matrix(batch.column("x"), features), _matrix(batch.column("w"), 1)[:, 0]
            for f in range(features):
                ok = ~np.isnan(x[:, f]) & (w > 0)
                if ok.any():
                    held[f] = _merged(np.append(held[f][0], x[ok, f]), np.append(held[f][1], w[ok]), SUMMARY)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(range(features), pa.int32()), "v": [v.tobytes() for v, _ in held], "w": [w.tobytes() for _, w in held]})

    def merge(t: pa.Table) -> pa.Table:
        v, w = (np.concatenate([np.frombuffer(b) for b in t[c].to_pylist()]) for c in "vw")
        found = edges_of(*_merged(v, w, 16 * SUMMARY), bins) if len(v) else np.zeros(0)
        return pa.table({"feature": t["feature"].slice(0, 1), "edges": pa.array([found.tobytes()])})

    rows = ready.mapInArrow(summaries, "feature int, v binary, w binary").groupBy("feature").applyInArrow(merge, "feature int, edges binary").collect()  # a row for each feature
    out = [np.zeros(0)] * features
    for r in rows:
        out[r["feature"]] = np.frombuffer(bytes(r["edges"]))
    return out


def _to_blocks(binning: Binning, codes: dict[str, int] | None, jobs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                y = b.column("y")
                arrays = (
                    binning.codes(_matrix(b.column("x"), len(binning.names))), _coded(b.column("category"), codes, binning.categories), _matrix(y, len(y[0])), _matrix(b.column("w"), len(b.column("w")[0])),
                    b.column("held").to_numpy(zero_copy_only=False).astype(bool), b.column("key").to_numpy(), np.zeros((n, jobs)),
                )
                yield pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([n], pa.int64())], names=["bins", "category", "y", "w", "held", "key", "pred", "n"])

    return run


# one pass


@dataclass
class Ask:
    """What a pass sums: trees since the blocks' predictions, the trees that grow, and each job's nodes to look at."""

    jobs: list[Job]
    base: list[float]
    targets: int
    weights: int
    features: int
    width: int
    categories: int
    pending: list[list[Tree]]
    growing: list[Tree | None]
    nodes: list[list[int]]
    columns: list[np.ndarray]
    round: int
    spans: list[dict[int, tuple[float, float]]] | None = None  # of residuals, where medians are sought


class Block:
    """Arrays of one row of the blocks."""

    def __init__(self, b: pa.RecordBatch, i: int, ask: Ask):
        n = b.column("n")[i].as_py()
        get = lambda c, kind: np.frombuffer(b.column(c)[i].as_buffer(), kind)
        self.bins, self.category = get("bins", np.uint8).reshape(n, ask.features), get("category", np.int32)
        self.y, self.w = get("y", float).reshape(n, ask.targets), get("w", float).reshape(n, ask.weights)
        self.held, self.key, self.pred = get("held", bool), get("key", np.int64), get("pred", float).reshape(n, len(ask.jobs))

    def predicted(self, ask: Ask, j: int) -> np.ndarray:
        out = self.pred[:, j] + ask.base[j]
        for t in ask.pending[j]:
            out = out + ask.jobs[j].params.rate * t.values(self.bins, self.category)
        return out

    def chosen(self, ask: Ask, j: int) -> np.ndarray:
        """Rows that tree `round` of the job learns from."""
        job = ask.jobs[j]
        ok = ~self.held & ~np.isnan(self.y[:, job.target]) & (self.weight(ask, j) > 0)
        if job.params.rows < 1:
            x = self.key.astype(np.uint64) ^ (np.uint64(job.seed * 1_000_003 + ask.round) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ok &= (x >> np.uint64(11)) < np.uint64(int(job.params.rows * (1 << 53)))
        return ok

    def weight(self, ask: Ask, j: int) -> np.ndarray:
        return self.w[:, min(ask.jobs[j].target, ask.weights - 1)]


def _blocks(batches: Iterator[pa.RecordBatch], ask: Ask) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield Block(b, i, ask)


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() // FAN_IN


def _histograms(ask: Ask):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        errors = np.zeros((len(ask.jobs), 2))
        for block in _blocks(batches, ask):
            for j, nodes in enumerate(ask.nodes):
                if not nodes:
                    continue
                job, tree = ask.jobs[j], ask.growing[j]
                pred, y = block.predicted(ask, j), block.y[:, job.target]
                if nodes == [0]:
                    ok = block.held & ~np.isnan(y)
                    errors[j] += np.abs(np.clip(pred[ok], 0, 5) - y[ok]).sum(), ok.sum()
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[tree.leaves(block.bins, block.category)]
                rows = np.flatnonzero((at >= 0) & block.chosen(ask, j))
                off = pred[rows] - y[rows]
                h = block.weight(ask, j)[rows]
                g = h * (off if job.params.loss == "squared" else np.sign(off) * (np.abs(off) > NOUGHT))
                categories = ask.categories if job.params.category else 0
                part = histogram(at[rows], len(nodes), block.bins[rows][:, ask.columns[j]], block.category[rows], g, h, ask.width, categories)
                sums[j] = sums[j] + part if j in sums else part
        for j, s in sums.items():
            for k, node in enumerate(ask.nodes[j]):
                yield _row(j, node, s[k])
            if errors[j, 1]:
                yield _row(j, -1, errors[j])

    return run


def _row(job: int, node: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([job], pa.int32()), pa.array([node], pa.int32()), pa.array([_part()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["job", "node", "part", "sums"])


def _added(t: pa.Table) -> np.ndarray:
    return np.sum([np.frombuffer(x.as_buffer()) for x in t["sums"]], axis=0)


def _sum_parts(t: pa.Table) -> pa.Table:
    return t.slice(0, 1).set_column(3, "sums", pa.array([_added(t).tobytes()], pa.binary()))


def _finder(ask: Ask):
    """The split of a node, or of all nodes of a level, from the summed histograms."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        job = t["job"][0].as_py()
        p, columns = ask.jobs[job].params, ask.columns[job]
        nodes = np.array(t["node"].to_pylist())
        summed = {int(n): _added(t.filter(pa.array(nodes == n))).reshape(3, -1) if n >= 0 else _added(t.filter(pa.array(nodes == n))) for n in np.unique(nodes)}
        if -1 in summed:
            out.append((job, -1, None, [], summed.pop(-1)))
        order = sorted(summed)
        if order:
            found = [best_split(summed[n], columns, ask.width, p) for n in order] if p.growth != "symmetric" else best_shared_split(np.stack([summed[n] for n in order]), columns, ask.width, p) or [None] * len(order)
            out += [(job, n, s, s.left_categories if s else [], totals(summed[n], ask.width)) for n, s in zip(order, found, strict=True)]
        pick = lambda f, kind: pa.array([f(s) if s else None for _, _, s, _, _ in out], kind)
        return pa.table({
            "job": pa.array([r[0] for r in out], pa.int32()), "node": pa.array([r[1] for r in out], pa.int32()), "gain": pick(lambda s: s.gain, pa.float64()), "feature": pick(lambda s: s.feature, pa.int32()),
            "bin": pick(lambda s: s.bin, pa.int32()), "missing_left": pick(lambda s: s.missing_left, pa.bool_()), "categories": pa.array([r[3] for r in out], pa.list_(pa.int32())),
            "l": pick(lambda s: [float(v) for v in s.left], pa.list_(pa.float64())), "r": pick(lambda s: [float(v) for v in s.right], pa.list_(pa.float64())), "whole": pa.array([[float(v) for v in r[4]] for r in out], pa.list_(pa.float64())),
        })

    return run


def _reduced(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.groupBy("job", "node", "part").applyInArrow(_sum_parts, rows.schema) if partitions > FAN_IN else rows


def _medians(ask: Ask):
    """Weights of residuals by cell of each leaf's span, with what lies below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [{n: np.zeros(CELLS + 2) for n in s} for s in ask.spans]
        for block in _blocks(batches, ask):
            for j, spans in enumerate(ask.spans):
                if not spans:
                    continue
                rows = np.flatnonzero(block.chosen(ask, j))
                leaf = ask.growing[j].leaves(block.bins[rows], block.category[rows])
                rest, w = block.y[rows, ask.jobs[j].target] - block.predicted(ask, j)[rows], block.weight(ask, j)[rows]
                for n, (low, high) in spans.items():
                    here = leaf == n
                    cell = np.clip(np.floor((rest[here] - low) / (high - low) * CELLS), -1, CELLS).astype(int) + 1
                    sums[j][n] += np.bincount(cell, w[here], CELLS + 2)
        for j, leaves in enumerate(sums):
            for n, s in leaves.items():
                yield _row(j, n, s)

    return run


def _median_cell(t: pa.Table) -> pa.Table:
    cum = np.cumsum(_added(t))
    cell = int(np.searchsorted(cum, cum[-1] / 2)) if cum[-1] > 0 else -1
    return pa.table({"job": t["job"].slice(0, 1), "node": t["node"].slice(0, 1), "cell": pa.array([cell], pa.int32())})


class Trainer:
    """Blocks and models of one call."""

    def __init__(self, blocks: DataFrame, ask: Ask):
        self.blocks, self.ask = blocks, ask
        self.partitions = blocks.rdd.getNumPartitions()
        self.trees: list[list[Tree]] = [[] for _ in ask.jobs]
        self.errors: list[list[float]] = [[] for _ in ask.jobs]

    def splits(self, growing: list[Tree | None], nodes: list[list[int]], columns: list[np.ndarray]) -> dict[tuple[int, int], tuple[Split | None, list[float]]]:
        """Splits and sums of all nodes, in as many passes as histograms need memory; errors of held rows under node -1."""
        out: dict = {}
        waiting = [list(n) for n in nodes]
        while any(waiting):
            room, now = PASS_BYTES, [[] for _ in waiting]
            for j, w in enumerate(waiting):
                p = self.ask.jobs[j].params
                size = 24 * (len(columns[j]) * self.ask.width + (self.ask.categories if p.category else 0))
                many = len(w) if p.growth == "symmetric" else min(len(w), max(room // size, 0 if any(now) else 1))
                if many * size <= room or not any(now):
                    now[j], waiting[j] = w[:many], w[many:]
                    room -= many * size
            ask = replace(self.ask, growing=growing, nodes=now, columns=columns)
            rows = _reduced(self.blocks.mapInArrow(_histograms(ask), "job int, node int, part int, sums binary"), self.partitions)
            shared = F.array(*(F.lit(j.params.growth == "symmetric") for j in self.ask.jobs))[F.col("job")]
            found = rows.groupBy("job", F.when(~shared, F.col("node")).alias("apart")).applyInArrow(_finder(ask), FOUND).collect()
            for r in found:
                s = Split(r["gain"], r["feature"], r["bin"], r["missing_left"], list(r["categories"]), tuple(r["l"]), tuple(r["r"])) if r["gain"] is not None else None
                out[r["job"], r["node"]] = s, r["whole"]
        return out

    def medians(self, growing: list[Tree | None], leaves: list[list[int]]) -> None:
        """Sets each leaf's value to the weighted median of its rows' residuals."""
        spans = [{n: (-16.0, 16.0) for n in own} for own in leaves]
        for _ in range(2):
            if not any(spans):
                return
            ask = replace(self.ask, growing=growing, spans=spans)
            rows = _reduced(self.blocks.mapInArrow(_medians(ask), "job int, node int, part int, sums binary"), self.partitions)
            for r in rows.groupBy("job", "node").applyInArrow(_median_cell, "job int, node int, cell int").collect():
                low, high = spans[r["job"]][r["node"]]
                step = (high - low) / CELLS
                low += step * min(max(r["cell"] - 1, 0), CELLS - 1)
                spans[r["job"]][r["node"]] = (low, low + step) if r["cell"] >= 0 else (-1e-9, 1e-9)
        for j, own in enumerate(spans):
            for n, (low, high) in own.items():
                growing[j].value[n] = (low + high) / 2

    def refresh(self) -> None:
        """Blocks with the predictions so far, written once; the old ones are let go."""
        ask = self.ask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                blocks = [Block(b, i, ask) for i in range(b.num_rows)]
                base = np.array(ask.base)
                pred = [np.stack([x.predicted(ask, j) for j in range(len(ask.jobs))], axis=1) - base for x in blocks]
                yield b.set_column(b.schema.get_field_index("pred"), "pred", pa.array([p.tobytes() for p in pred], pa.binary()))

        old = self.blocks
        self.blocks = cut(old.mapInArrow(run, BLOCK)).persist()
        old.unpersist()
        self.ask = replace(ask, pending=[[] for _ in ask.jobs])


def _columns(job: Job, features: int, t: int) -> np.ndarray:
    many = max(1, round(job.params.columns * features))
    return np.arange(features) if many == features else np.sort(np.random.default_rng([job.seed, t]).choice(features, many, replace=False))


class Growing:
    """One tree on its way: splits that are known for nodes of a tree that may be larger than the one that is kept."""

    def __init__(self, p: Params):
        self.p, self.tree, self.known, self.sums, self.depth, self.asked = p, Tree(), {}, {}, {0: 0}, set()

    def wanted(self) -> list[int]:
        """Nodes whose split has to be known next."""
        if 0 not in self.known:
            return [0]
        for node in self._next():
            if node not in self.asked:
                self.asked.add(node)
                for child in self.tree.grow(node, self.known[node]):
                    self.depth[child] = self.depth[node] + 1
        return [n for n in self.depth if n not in self.known and not self._full(n)]

    def _full(self, node: int) -> bool:
        return bool(self.p.depth) and self.depth[node] >= self.p.depth

    def _next(self) -> list[int]:
        if self.p.growth == "leaf":
            return self._queue()
        return [n for n, s in self.known.items() if s and n not in self.asked]

    def _queue(self) -> list[int]:
        """Nodes that the queue of gains takes, in order, as far as gains are known."""
        out, heap = [], [(-self.known[0].gain, 0)] if self.known[0] else []
        while heap and len(out) < self.p.leaves - 1:
            _, node = heapq.heappop(heap)
            out.append(node)
            if node in self.asked:
                for child in (self.tree.left[node], self.tree.right[node]):
                    if self.known.get(child):
                        heapq.heappush(heap, (-self.known[child].gain, child))
        return out

    def finished(self) -> Tree:
        """The tree of the splits that are kept, with second-order values."""
        kept = set(self._queue() if self.p.growth == "leaf" else self.asked)
        out = Tree()
        todo = [(0, 0)]
        while todo:
            node, at = todo.pop()
            if node in kept:
                for child, new in zip((self.tree.left[node], self.tree.right[node]), out.grow(at, self.known[node]), strict=True):
                    self.sums.setdefault(child, (self.known[node].left, self.known[node].right)[child == self.tree.right[node]])
                    todo.append((child, new))
            else:
                g, h, _ = self.sums[node]
                out.value[at] = weight(g, h, self.p)
        return out


def train_jobs(
    df: DataFrame, names: Sequence[str], targets: Sequence[str], jobs: Sequence[Job], category: str | None = None, weights: Sequence[str] | None = None, held: str | None = None,
    rivals: list[list[float]] | None = None,
) -> Boosted:
    """Trains all jobs at once.

    `weights` has a column for each target; `held` names a boolean column: a job stops once the mean absolute error (of predictions held to
    0..5) on its rows has not fallen for its `patience`, and keeps the trees up to the best, one at least. With `rivals` (errors of earlier models by
    trees) a job also stops once its error is above the median of theirs and of the other jobs' at equal trees. Not one row goes to the driver.
    """
    trainer, model = prepare(df, names, targets, jobs, category, weights, held)
    _boost(trainer, held is not None, rivals)
    trainer.blocks.unpersist()
    model.trees, model.errors = trainer.trees, trainer.errors
    return model


def prepare(df: DataFrame, names: Sequence[str], targets: Sequence[str], jobs: Sequence[Job], category: str | None = None, weights: Sequence[str] | None = None, held: str | None = None) -> tuple[Trainer, Boosted]:
    """Binned blocks and models without trees."""
    names, jobs = list(names), list(jobs)
    w = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in weights] if weights else [F.lit(1.0)]
    used = F.lit(True) if held is None else ~F.coalesce(F.col(held), F.lit(False))
    ready = df.select(
        F.array(*(F.col(f"`{n}`").cast("double") for n in names)).alias("x"), _category(category).alias("category"), F.array(*(F.col(y).cast("double") for y in targets)).alias("y"), F.array(*w).alias("w"),
        (~used).alias("held"), F.xxhash64(*(F.col(f"`{n}`") for n in names), *targets).alias("key"),
    )
    codes, categories = None, 0
    if category and any(j.params.category for j in jobs):
        found = [r[0] for r in ready.select("category").distinct().limit(MOST_CATEGORIES + 1).collect()]
        codes = {c: i for i, c in enumerate(sorted(found))} if len(found) <= MOST_CATEGORIES else None
        categories = MOST_CATEGORIES if codes is None else len(codes)
    fitted = ready.filter(~F.col("held"))
    binning = Binning(names, find_edges(fitted.select("x", F.slice("w", 1, 1).alias("w")), len(names), min(j.params.bins for j in jobs)), categories)
    blocks = ready.mapInArrow(_to_blocks(binning, codes, len(jobs)), BLOCK).persist()
    mean = lambda j: F.try_divide(F.sum(F.when(ok(j), weight_of(j) * target_of(j))), F.sum(F.when(ok(j), weight_of(j)))).alias(str(j))
    target_of, weight_of = (lambda j: F.col("y")[jobs[j].target]), (lambda j: F.col("w")[min(jobs[j].target, len(w) - 1)])
    ok = lambda j: target_of(j).isNotNull() & ~F.isnan(target_of(j))
    base = [float(v or 0.0) for v in fitted.agg(*(mean(j) for j in range(len(jobs)))).first()]
    ask = Ask(jobs, base, len(targets), len(w), len(names), binning.width, categories, [[] for _ in jobs], [None] * len(jobs), [[] for _ in jobs], [np.arange(0)] * len(jobs), 0)
    trainer = Trainer(blocks, ask)
    absolute = [j.params.loss == "absolute" for j in jobs]
    if any(absolute):  # these begin with the median
        roots = [Tree() if a else None for a in absolute]
        trainer.ask = replace(ask, base=[0.0] * len(jobs))
        trainer.medians(roots, [[0] if a else [] for a in absolute])
        base = [r.value[0] if r else b for r, b in zip(roots, base, strict=True)]
        trainer.ask = replace(ask, base=base)
    return trainer, Boosted(names, category, binning, codes, jobs, base)


#: Trees before which no model is given up for its rivals.
WARM_UP = 5


def _hopeless(errors: list[list[float]], rivals: list[list[float]], j: int, t: int) -> bool:
    others = [e[t] for e in [*rivals, *errors[:j], *errors[j + 1 :]] if len(e) > t]
    return t >= WARM_UP and len(errors[j]) > t and len(others) > 1 and errors[j][t] > float(np.median(others))


def _boost(trainer: Trainer, stops: bool, rivals: list[list[float]] | None = None) -> None:
    jobs = trainer.ask.jobs
    best: list[tuple[float, int]] = [(float("inf"), 0)] * len(jobs)
    open_jobs, t = set(range(len(jobs))), 0
    while open_jobs:
        columns = [_columns(j, trainer.ask.features, t) for j in jobs]
        trainer.ask = replace(trainer.ask, round=t)
        growing = {j: Growing(jobs[j].params) for j in sorted(open_jobs)}
        while any(nodes := [growing[j].wanted() if j in growing else [] for j in range(len(jobs))]):
            found = trainer.splits([growing[j].tree if j in growing else None for j in range(len(jobs))], nodes, columns)
            for (j, node), (split, sums) in found.items():
                if node < 0:
                    error = sums[0] / sums[1]
                    best[j] = min(best[j], (error, t))
                    trainer.errors[j].append(error)
                else:
                    growing[j].known[node], growing[j].sums[node] = split, tuple(sums)
            for j, own in enumerate(nodes):
                for n in own:  # a node without rows
                    if (j, n) not in found:
                        growing[j].known[n] = None
                        growing[j].sums.setdefault(n, (0.0, 0.0, 0.0))
            for j in [j for j in growing if stops and (t - best[j][1] >= jobs[j].params.patience or t >= jobs[j].params.trees or (rivals is not None and _hopeless(trainer.errors, rivals, j, t)))]:  # the pass told the error of t trees
                open_jobs.discard(j)
                del growing[j]
        done = {j: g.finished() for j, g in growing.items()}
        for j in [j for j, tree in done.items() if len(tree.feature) == 1]:  # nothing gains any more
            open_jobs.discard(j)
            del done[j]
        medians = [done.get(j) if jobs[j].params.loss == "absolute" else None for j in range(len(jobs))]
        trainer.medians(medians, [[n for n, f in enumerate(m.feature) if f == LEAF] if m else [] for m in medians])
        for j, tree in done.items():
            trainer.trees[j].append(tree)
            trainer.ask.pending[j].append(tree)
        t += 1
        if not stops:
            open_jobs = {j for j in open_jobs if t < jobs[j].params.trees}
        if open_jobs and t % REFRESH == 0:
            trainer.refresh()
    if stops:
        for j, (error, at) in enumerate(best):
            if error < float("inf"):  # some rows are held
                del trainer.trees[j][max(at, 1) :]


def ordered_target_mean(df: DataFrame, key: str, target: str, order: Sequence[str], seed: int = 42, prior: float | None = None, weight_of_prior: float = 1.0, to: str = "target_mean") -> DataFrame:
    """Adds the mean target of the key's rows that come before the row in a fixed random order, pulled to the prior.

    No row sees its own target or a later one's. Prefix sums go by 4096 buckets of the order, then inside a bucket, so a key with a
    large share of all rows is spread over as many tasks. Rows without a target take part as readers only.
    """
    digest = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in (key, *order)), F.lit(str(seed))).cast("binary"))
    prior = df.agg(F.avg(target)).first()[0] if prior is None else prior
    placed = df.withColumn("_order", digest).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    sums = placed.groupBy(key, "_bucket").agg(F.sum(target).alias("_sum"), F.count(target).alias("_count"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.sum("_sum").over(before).alias("_sums"), F.sum("_count").over(before).alias("_counts"))
    inside = Window.partitionBy(key, "_bucket").orderBy("_order", *order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({"_s": F.sum(target).over(inside), "_c": F.count(target).over(inside)})
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = own.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")), "left")
    s, c = zero(F.col("_s")) + zero(F.col("_sums")), zero(F.col("_c")) + zero(F.col("_counts"))
    return joined.select(*df.columns, ((s + F.lit(float(prior or 0.0) * weight_of_prior)) / (c + weight_of_prior)).alias(to))
