"""Extremely randomised trees, level by level: thresholds are drawn, not searched.

A level takes two passes over the binned blocks for all trees of all targets at once. The first finds the least and the largest bin of every
feature in every node; between their edges a threshold is drawn by node, feature and seed. The second sums targets left of
each drawn threshold; of the features that a node draws the one that lowers the squared error most splits it. Passes send
a few numbers for each node and feature, whatever the rows.

Defined results: missing values go left; a node whose features have one value each, or too few rows on a side, is a leaf
with the weighted mean of its targets; rows without a target do not count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Ask, Boosted, Job, Params, _added, _blocks, _reduced, _row, prepare
from .trees import Split, Tree

#: Nodes of all trees that one pass looks at.
NODES = 4096


def _rows_by_node(ask: Ask, block, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the wanted nodes, sorted by node, with the nodes and where each begins."""
    tree, nodes = ask.growing[j], np.array(ask.nodes[j])
    at = tree.leaves(block.bins, block.category)
    rows = np.flatnonzero(np.isin(at, nodes) & block.chosen(ask, j))
    rows = rows[np.argsort(at[rows], kind="stable")]
    found, first = np.unique(at[rows], return_index=True)
    return rows, found, first


def _extents(ask: Ask):
    """Least (as 255 - bin) and largest bin of every feature without its missing values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for block in _blocks(batches, ask):
            for j, nodes in enumerate(ask.nodes):
                if nodes:
                    rows, found, first = _rows_by_node(ask, block, j)
                    if len(rows):
                        bins = block.bins[rows].astype(np.int16)
                        low = np.maximum.reduceat(np.where(bins == 0, -1, 255 - bins), first, axis=0)
                        high = np.maximum.reduceat(np.where(bins == 0, -1, bins), first, axis=0)
                        gone = np.maximum.reduceat(bins == 0, first, axis=0)
                        for k, n in enumerate(found):
                            now = np.stack([low[k], high[k], gone[k]]).astype(float)
                            out[j, int(n)] = np.maximum(out[j, int(n)], now) if (j, int(n)) in out else now
        for (j, n), x in out.items():
            yield _row(j, n, x)

    return run


def _largest(t: pa.Table) -> pa.Table:
    x = np.max([np.frombuffer(v.as_buffer()) for v in t["sums"]], axis=0)
    return pa.table({"job": t["job"].slice(0, 1), "node": t["node"].slice(0, 1), "extent": pa.array([x.astype(np.int16).tobytes()], pa.binary())})


def threshold(edges: np.ndarray, low: int, high: int, missing: bool, u: float) -> int:
    """The bin up to which rows go left, for a number u in 0..1; -1 where all rows have one value."""
    if low >= high:
        return low - 1 if missing and low > 0 else -1
    a, b = edges[low - 1], edges[high - 2]
    return int(np.clip(np.searchsorted(edges, a + u * (b - a), "right"), low, high - 1))


def draw(ask: Ask, edges: Sequence[np.ndarray], j: int, node: int, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node may split on, and their thresholds."""
    job = ask.jobs[j]
    rng = np.random.default_rng([job.seed, job.target, node])
    u = rng.random(len(edges))
    order = rng.permutation(len(edges))
    low, high, gone = 255 - extent[0], extent[1], extent[2] > 0
    limit = np.array([threshold(e, int(a), int(b), bool(g), x) if b > 0 else -1 for e, a, b, g, x in zip(edges, low, high, gone, u, strict=True)])
    usable = order[limit[order] >= 0]  # features with one value do not count as drawn
    return np.sort(usable[: max(1, round(job.params.columns * len(edges)))]), limit


def _left_sums(ask: Ask, drawn: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
    """Weighted targets, weights and rows left of each drawn threshold, and of the whole node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for block in _blocks(batches, ask):
            for j, nodes in enumerate(ask.nodes):
                if not nodes:
                    continue
                rows, found, first = _rows_by_node(ask, block, j)
                for n, here in zip(found, np.split(rows, first[1:]), strict=True):
                    if (j, int(n)) in drawn:
                        columns, limit = drawn[j, int(n)]
                        w = block.weight(ask, j)[here]
                        facts = np.stack([w * block.y[here, ask.jobs[j].target], w, np.ones(len(here))])
                        left = facts @ (block.bins[here][:, columns] <= limit[columns])
                        now = np.concatenate([left, facts.sum(axis=1)[:, None]], axis=1)
                        out[j, int(n)] = out.get((j, int(n)), 0.0) + now
        for (j, n), x in out.items():
            yield _row(j, n, x)

    return run


def _choice(ask: Ask, drawn: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
    def run(t: pa.Table) -> pa.Table:
        j, n = t["job"][0].as_py(), t["node"][0].as_py()
        p, x = ask.jobs[j].params, _added(t).reshape(3, -1)
        left, whole = x[:, :-1], x[:, -1:]
        right = whole - left
        ok = np.minimum(left[2], right[2]) >= max(p.least_rows, 1)
        gain = np.full(left.shape[1], -np.inf)
        gain[ok] = left[0, ok] ** 2 / left[1, ok] + right[0, ok] ** 2 / right[1, ok] - whole[0] ** 2 / whole[1]
        k = int(np.argmax(gain)) if len(gain) else -1
        good = k >= 0 and gain[k] > 1e-12
        feature = int(drawn[j, n][0][k]) if good else -1
        return pa.table({
            "job": pa.array([j], pa.int32()), "node": pa.array([n], pa.int32()), "feature": pa.array([feature], pa.int32()), "gain": [float(gain[k]) if good else 0.0],
            "l": pa.array([left[:, k].tolist() if good else []], pa.list_(pa.float64())), "whole": pa.array([whole[:, 0].tolist()], pa.list_(pa.float64())),
        })

    return run


def train_forest(df: DataFrame, names: Sequence[str], targets: Sequence[str], trees: int, p: Params, seed: int = 42, weights: Sequence[str] | None = None) -> Boosted:
    """`trees` trees for each target: jobs come target by target, each with one tree and no learning rate."""
    jobs = [Job(t, seed + k, replace(p, rate=1.0, category=False)) for t in range(len(targets)) for k in range(trees)]
    trainer, model = prepare(df, names, targets, jobs, None, weights)
    edges = model.binning.edges
    growing, level = [Tree() for _ in jobs], [[0] for _ in jobs]
    for depth in range(p.depth + 1):
        after: list[list[int]] = [[] for _ in jobs]
        for nodes in _portions(level):
            ask = replace(trainer.ask, base=[0.0] * len(jobs), growing=growing, nodes=nodes)
            drawn = {}
            if depth < p.depth:
                spans = _reduced_max(trainer, ask)
                drawn = {k: draw(ask, edges, *k, v) for k, v in spans.items()}
            else:
                drawn = {(j, n): (np.zeros(0, int), np.zeros(len(edges), int)) for j, own in enumerate(nodes) for n in own}
            rows = _reduced(trainer.blocks.mapInArrow(_left_sums(ask, drawn), "job int, node int, part int, sums binary"), trainer.partitions)
            for r in rows.groupBy("job", "node").applyInArrow(_choice(ask, drawn), "job int, node int, feature int, gain double, l array<double>, whole array<double>").collect():
                j, n, whole = r["job"], r["node"], np.array(r["whole"])
                growing[j].value[n] = float(whole[0] / whole[1])
                if r["feature"] >= 0:
                    left = np.array(r["l"])
                    split = Split(r["gain"], r["feature"], int(drawn[j, n][1][r["feature"]]), True, [], tuple(left), tuple(whole - left))
                    after[j] += growing[j].grow(n, split)
        level = [sorted(own) for own in after]
        if not any(level):
            break
    trainer.blocks.unpersist()
    model.base, model.trees = [0.0] * len(jobs), [[t] for t in growing]
    return model


def _portions(level: list[list[int]]) -> Iterator[list[list[int]]]:
    """The nodes of a level, at most about NODES at once."""
    now, many = [[] for _ in level], 0
    for j, own in enumerate(level):
        for i in range(0, len(own), NODES):
            now[j] = own[i : i + NODES]
            many += len(now[j])
            if many >= NODES:
                yield now
                now, many = [[] for _ in level], 0
    if many:
        yield now


def _reduced_max(trainer, ask: Ask) -> dict[tuple[int, int], np.ndarray]:
    rows = trainer.blocks.mapInArrow(_extents(ask), "job int, node int, part int, sums binary")
    found = rows.groupBy("job", "node").applyInArrow(_largest, "job int, node int, extent binary").collect()
    return {(r["job"], r["node"]): np.frombuffer(bytes(r["extent"]), np.int16).reshape(3, -1) for r in found}
