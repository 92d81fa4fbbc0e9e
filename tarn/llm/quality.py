"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights is shared by all grades; ordered thresholds t_1 < t_2 < ... split the score line:
P(grade <= j) = sigmoid(t_j - w.x). That gives each text an expected grade and the tail probability
P(grade >= wanted) by which texts are selected. Features are shares of hashed words and of word shapes, so a text's
length doesn't matter.

Defined results: null and empty texts have no features and get the grades' prior through the thresholds; with fewer
than two grades among the labelled rows, every text gets that grade (0 without labels) with certainty; conflicting
labels of one document count as their lowest; rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import folded
from .words import SPACED, U, passes, words

#: Word buckets; shapes have buckets of their own behind them.
WORD_BITS, SHAPE_BITS = 14, 9
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Labelled documents that the fit takes at most, and its passes over them.
SAMPLE, STEPS = 4000, 150


def _shares(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, feature and weight of every word and every word's shape."""
    w = words(texts, SPACED)
    data = w.data
    total = lambda flag: (c := np.concatenate([[0], np.cumsum(flag)]))[w.end] - c[w.start]
    upper = total((data >= 65) & (data <= 90))
    lower = total((data >= 97) & (data <= 122) | (data >= 128))
    digit = total((data >= 48) & (data <= 57))
    length = w.end - w.start
    other = length - upper - lower - digit
    n = len(w.hash)
    same = np.zeros(n, np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = np.minimum(other, 3) | np.minimum(upper, 2).clip(0, 3) << 2 | (lower > 0) << 4 | (digit > 0) << 5 | same << 6 | np.searchsorted([4, 8, 16], length) << 7
    doc = np.concatenate([w.doc, w.doc])
    at = np.concatenate([(w.hash >> U(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + shape % (1 << SHAPE_BITS)])
    return doc, at, 1 / np.maximum(w.counts, 1)[doc], w.n_docs


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in passes(batch.column("text")):
            doc, at, weight, n = _shares(batch.column("text")[s.start : s.stop])
            key, back = np.unique(doc * SIZE + at, return_inverse=True)
            value = np.bincount(back, weight, len(key))
            edges = np.searchsorted(key // SIZE, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade")[s.start : s.stop], *(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)) for x in ((key % SIZE).astype(np.int32), value.astype(np.float32)))], names=["grade", "at", "value"]
            )


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for every grade but the lowest, by rows."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit(rows: list, steps: int = STEPS, rate: float = 0.3, decay: float = 1e-6) -> Ordinal:
    """Maximum likelihood by Adam; `rows` have grade, at and value."""
    rows = [r for r in rows if r["grade"] is not None]
    grades = sorted({r["grade"] for r in rows})
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(SIZE), np.zeros(0))
    y = np.searchsorted(grades, [r["grade"] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.concatenate([np.asarray(r["at"], np.int64) for r in rows])
    value = np.concatenate([np.asarray(r["value"], float) for r in rows])
    scale = 1 / np.bincount(y, minlength=len(grades))[y]  # grades count alike
    scale *= len(rows) / scale.sum()
    k = len(grades) - 1
    # thresholds: a first one and positive gaps
    theta = np.zeros(SIZE + k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        t = theta[SIZE] + np.concatenate([[0], np.cumsum(np.exp(theta[SIZE + 1 :]))])
        score = np.bincount(doc, theta[at] * value, len(rows))
        edge = 1 / (1 + np.exp(np.clip(score[:, None] - t[None, :], -40, 40)))  # P(grade <= j)
        full = np.concatenate([np.zeros((len(rows), 1)), edge, np.ones((len(rows), 1))], 1)
        slope = np.concatenate([np.zeros((len(rows), 1)), edge * (1 - edge), np.zeros((len(rows), 1))], 1)
        i = np.arange(len(rows))
        p = np.maximum(full[i, y + 1] - full[i, y], 1e-12)
        by_score = scale * (slope[i, y + 1] - slope[i, y]) / p
        by_t = np.zeros((len(rows), k))
        high, low = y < k, y > 0
        by_t[i[high], y[high]] -= (scale * slope[i, y + 1] / p)[high]
        by_t[i[low], y[low] - 1] += (scale * slope[i, y] / p)[low]
        by_t = by_t.sum(0)
        g = np.zeros_like(theta)
        g[:SIZE] = np.bincount(at, value * by_score[doc], SIZE) / len(rows) + decay * theta[:SIZE]
        g[SIZE] = by_t.sum() / len(rows)
        for j in range(1, k):
            g[SIZE + j] = by_t[j:].sum() * np.exp(theta[SIZE + j]) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    t = theta[SIZE] + np.concatenate([[0], np.cumsum(np.exp(theta[SIZE + 1 :]))])
    return Ordinal([int(g) for g in grades], theta[:SIZE], t)


def train(docs: DataFrame, labels: DataFrame, rating: str = "quality", sample: int = SAMPLE) -> Ordinal:
    """Fit on at most `sample` labelled documents, chosen by a hash of their id; rows that repeat an id count once for each text."""
    rated = labels.filter(F.col(rating).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(rating).cast("int").alias("grade"))
    order = F.xxhash64(F.col("doc_id"), F.lit(8))
    chosen = rated.orderBy(order, "doc_id").limit(sample)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("which", F.xxhash64("text"))
    # rows that repeat an id may exceed the bound, so it is set again, in the same order
    texts = found.dropDuplicates(["doc_id", "which"]).orderBy(order, "doc_id", "which").limit(sample).select("grade", "text")
    rows = texts.mapInArrow(_features, "grade int, at array<int>, value array<float>").collect()
    rows.sort(key=lambda r: (r["grade"], len(r["at"]), r["at"], r["value"]))
    return fit(rows)


def linear_score(text: Column, model: Ordinal) -> Column:
    weights = model.weights.astype(np.float32)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for s in passes(texts):
            doc, at, weight, n = _shares(texts[s.start : s.stop])
            out.append(np.bincount(doc, weights[at] * weight, n))
        return pa.array(np.concatenate(out))

    return score(text)


def rate(docs: DataFrame, model: Ordinal, wanted: int | None = None, least: float = 0.5) -> DataFrame:
    """`docs` with expected_grade, tail_prob = P(grade >= wanted) and keep = tail_prob >= least.

    Columns of `docs` with these names are replaced; any others stay as they are. Null texts count as empty ones.
    """
    wanted = model.grades[-1] if wanted is None else wanted
    if not len(model.thresholds):
        sure = float(model.grades[0] >= wanted)
        return docs.withColumn("expected_grade", F.lit(float(model.grades[0]))).withColumn("tail_prob", F.lit(sure)).withColumn("keep", F.lit(sure >= least))
    slim, rest = folded(docs, "text")
    out = slim.withColumn("__score", linear_score(F.coalesce(F.col("text"), F.lit("")), model))
    tails = [1 / (1 + F.exp(F.lit(float(t)) - F.col("__score"))) for t in model.thresholds]
    expected = F.lit(float(model.grades[0]))
    for low, high, tail in zip(model.grades, model.grades[1:], tails):
        expected = expected + F.lit(float(high - low)) * tail
    above = [tail for grade, tail in zip(model.grades[1:], tails) if grade >= wanted]
    tail = F.lit(1.0) if wanted <= model.grades[0] else above[0] if above else F.lit(0.0)
    made = {"expected_grade": expected, "tail_prob": tail, "keep": tail >= least}
    others = [c for c in docs.columns if c not in made]
    return out.select(*(rest(c) for c in others), *(v.alias(k) for k, v in made.items()))
