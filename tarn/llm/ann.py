"""Approximate nearest neighbours by cross-polytope hashing.

Every table turns unit vectors by three rounds of random signs and a fast Hadamard transform and assigns each to
its nearest signed axis, 2d cells a table. A query probes, in every table, the cells of its largest coordinates;
each cell's members are compared exactly, in double precision, with the queries that probe it, and the best of all
cells win. A cell is dealt over blocks of about BLOCK vectors and its queries over groups of about BLOCK, so a vector that a
third of all rows repeat spreads over many tasks, and a task holds one block and one group. What leaves a block is the
best k of each query, never its pairs.

The cells of a table are 2d, whatever the number of vectors. Queries that are a fixed share of the rows meet a fixed share of
the vectors, so comparisons grow with the square of the rows, and so do, beyond BLOCK vectors in a cell, the copies of
queries that cross the shuffle: one for each block of each cell that they probe.

Defined results: vectors that are null, of another length than most, zero, or hold nulls or non-finite components
take no part, neither as queries nor as candidates; null ids take no part; rows that repeat an id are candidates of
their own, but a query's own id never is one; of repeated (query, candidate) ids the best score counts; ties go to the
smaller id; a query with fewer candidates than k has them all. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Tables, cells that a query probes in each, and vectors of a cell that one block holds.
TABLES, PROBES, BLOCK = 8, 16, 4096
#: A score within this of a block's k-th best is computed again by itself, so that ties are exact.
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, a power of two wide."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / d**0.5


def rotations(tables: int, dim: int, seed: int = 4) -> np.ndarray:
    """Random signs: tables x 3 rounds x width, the power of two from dim on."""
    width = 1 << max(0, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Both directions of every axis: 2 x width columns."""
    y = np.zeros((len(x), signs.shape[-1]))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _cells(signs: np.ndarray, probes: int):
    tables, _, width = signs.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = matrix(part.column("vector"))
                x = x / np.abs(x).max(1, keepdims=True)  # the norm of very large or small components would leave the range
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                out = np.empty((len(x), tables, probes), np.int32)
                for t in range(tables):
                    y = turned(x, signs[t])
                    if probes == 1:
                        out[:, t, 0] = y.argmax(1)
                    else:
                        best = np.argpartition(-y, probes - 1, axis=1)[:, :probes]
                        out[:, t] = best
                    out[:, t] += t * 2 * width
                flat = pa.array(out.ravel())
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables * probes), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), cells], names=["id", "vector", "cells"])

    return assign


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with its row of b: the same pair of vectors always has the same value."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _nearest(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[pa.RecordBatch] = []
        vectors: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not queries or not vectors:
                return
            q, v = pa.Table.from_batches(queries).combine_chunks(), pa.Table.from_batches(vectors).combine_chunks()
            qx, vx = matrix(q["vector"].combine_chunks()), matrix(v["vector"].combine_chunks())
            qi, vi = q["id"].to_numpy(), v["id"].to_numpy()
            unit = [m / np.abs(m).max(1, keepdims=True) for m in (qx, vx)]
            unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in unit]
            for i in range(0, len(qi), 256):
                s = unit[0][i : i + 256] @ unit[1].T
                s[qi[i : i + 256, None] == vi[None, :]] = -2
                n = min(k, s.shape[1])
                least = np.maximum(np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n], -1.5)
                row, col = np.nonzero(s >= least[:, None] - SLACK)
                score = cosines(qx[i + row], vx[col])
                order = np.lexsort((vi[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                begin = np.searchsorted(row, row, "left")
                keep = np.arange(len(row)) - begin < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[i + row[keep]]), pa.array(vi[col[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            block = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "group")), strict=True))
            is_query = np.array(batch.column("is_query").to_pylist(), bool)
            i = 0
            while i < len(block):
                j = i
                while j < len(block) and block[j] == block[i]:
                    j += 1
                if block[i] != now:
                    yield from flush()
                    now, queries, vectors = block[i], [], []
                part, flag = batch.slice(i, j - i).select(["id", "vector"]), is_query[i:j]
                if flag.any():
                    queries.append(part.filter(pa.array(flag)))
                if not flag.all():
                    vectors.append(part.filter(pa.array(~flag)))
                i = j
        yield from flush()

    return search


def usable(vector: Column, dim: int) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES, seed: int = 4) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found of every row with `is_query`.

    vectors: vec_id, embedding. Every row that takes part is in the index.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter("id is not null and vector is not null")
    dims = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).filter("dim > 0").limit(1).collect()
    dim = dims[0]["dim"] if dims else 1
    rows = rows.filter(usable(F.col("vector"), dim))
    signs = rotations(tables, dim, seed)
    probes = min(probes, 2 * signs.shape[-1])
    schema = f"id long, vector {kind}, cells array<int>"
    index = rows.select("id", "vector").mapInArrow(_cells(signs, 1), schema).select("id", "vector", F.explode("cells").alias("cell"))
    asked = rows.filter("is_query").select("id", "vector").dropDuplicates(["id", "vector"]).mapInArrow(_cells(signs, probes), schema).select("id", "vector", F.explode("cells").alias("cell"))
    blocks = cut(index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # 2 d rows a table at most
    def search(queries: DataFrame) -> DataFrame:
        groups = cut(queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups")))  # 2 d rows a table at most
        group = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("groups")).cast("int")
        spread = queries.join(F.broadcast(blocks), "cell").join(F.broadcast(groups), "cell")
        spread = spread.select("id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), group.alias("group"), F.lit(True).alias("is_query"))
        # cells that no query probes stay out
        held = salted.join(F.broadcast(groups), "cell").select("id", "vector", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(False).alias("is_query"))
        together = held.union(spread).repartition("cell", "block", "group").sortWithinPartitions("cell", "block", "group")
        found = together.mapInArrow(_nearest(k), "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    salted = index.join(F.broadcast(blocks), "cell").select("id", "vector", "cell", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    best = cut(search(asked))
    # queries whose cells held fewer than k candidates meet every vector, through all cells of the first table
    enough = best.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = rows.filter("is_query").select("id", "vector").dropDuplicates(["id", "vector"]).join(enough, "id", "left_anti")
    if not short.isEmpty():
        everywhere = short.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(2 * signs.shape[-1] - 1))).alias("cell"))
        best = best.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").union(search(everywhere))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
