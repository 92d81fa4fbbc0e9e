"""Periodic runs of words: stretches that repeat one group of words at least three times.

A run with smallest period q has at least 24 words and 3 q of them, so it overlaps itself, moved by q, in 16 words or more:
24 - q where q is at most 8, else 2 q. Hence all its words lie in 16-grams of words that stand more than once in the text, and no other word can
join a run. Those words are found by one sort of 64-bit hashes for a whole block of texts (hashes that collide only
let more words through); on the stretches that survive, and only there, Main and Lorentz's division finds every run.

The division is done for all stretches of a block at once, level by level. At a middle m, each period p is tried by how
far the words from m and from m + p (or m - p) agree forwards, and how far those before them agree backwards. Agreement
is read from exact ranks of all stretches of 1, 2, 4, ... words, so no result rests on a hash. A stretch that is found with a multiple
of its smallest period is found with the smallest too, at the same ends, and the smallest is kept.

Defined results: words are what lies between ASCII white space; null and empty texts have no words and no runs, and the digest of
nothing; texts of any length are taken whole, in one task; rows are independent, so repeated rows repeat their result; the
longest exponent's ties go to the smallest start, then period; an empty table gives an empty table. Only doc_id and text are read, so
other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BASE, U, give_back, mix, passes

#: A run's least length in words and in periods.
LEAST, TIMES = 24, 3
#: Words in which a run at least overlaps itself when it is moved by its period.
OVERLAP = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST))
#: Bytes of text whose words are searched at once, unless one text is longer.
BLOCK_BYTES = 4 << 20
#: Pairs of places that are compared at once.
STEP = 1 << 20

FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def survivors(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that lie in an OVERLAP-gram which their own text holds more than once."""
    n = len(ids)
    masked = np.zeros(n, bool)
    if n < OVERLAP:
        return masked
    gram, width = mix(ids.astype(U) + U(1)), 1
    while width < OVERLAP:  # OVERLAP is a power of two
        gram = mix(gram[:-width] * BASE + gram[width:])
        width *= 2
    inside = doc[: len(gram)] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    key = mix(gram[at] ^ (doc[at].astype(U) * BASE))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    again = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.cumsum(edge[:-1]) > 0


class Ranks:
    """How far two places of a sequence agree, from exact ranks of its stretches of 1, 2, 4, ... items."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n, self.levels = len(ids), [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= longest:
            below = self.levels[-1]
            pairs = below[:-half].astype(np.int64) * self.n + below[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Items from a on, each of which equals that from b on; a < b."""
        agreed = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            self._further(k, a + agreed, b + agreed, 0, agreed)
        return agreed

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Items up to a, each of which equals that up to b; a < b."""
        agreed = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            self._further(k, a - agreed, b - agreed, (1 << k) - 1, agreed)
        return agreed

    def _further(self, k: int, a: np.ndarray, b: np.ndarray, back: int, agreed: np.ndarray) -> None:
        level = self.levels[k]
        ok = np.flatnonzero((a >= back) & (b - back < len(level)))
        ok = ok[level[a[ok] - back] == level[b[ok] - back]]
        agreed[ok] += 1 << k


def maximal_runs(stretches: list[np.ndarray]) -> np.ndarray:
    """Rows (stretch, start, length, smallest period) of all runs, by Main and Lorentz's division of all stretches at once."""
    stretches = [np.asarray(s, np.int64) for s in stretches]
    size = np.array([len(s) for s in stretches], np.int64)
    first = np.cumsum(size + 1) - size - 1
    if not len(size) or size.max() < LEAST:
        return np.zeros((0, 4), np.int64)
    ids = np.concatenate([np.append(s, -1 - i) for i, s in enumerate(stretches)])  # ends that equal nothing
    ranks = Ranks(ids, int(size.max()))
    low, high, found = first.copy(), first + size, []
    while True:
        big = high - low >= LEAST
        low, high = low[big], high[big]
        if not len(low):
            break
        middle = (low + high) // 2
        most = (high - low) // TIMES
        for side, room in ((1, high - middle), (-1, middle - low)):
            found += _around(ids, ranks, middle, np.minimum(most, room), side)
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
    runs = np.unique(np.concatenate(found or [np.zeros((0, 3), np.int64)]), axis=0)  # by start, end, period
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # the smallest period of equal ends
    runs = runs[keep]
    of = np.searchsorted(first, runs[:, 0], "right") - 1
    return np.stack([of, runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)


def _around(ids: np.ndarray, ranks: Ranks, middle: np.ndarray, most: np.ndarray, side: int) -> list[np.ndarray]:
    """(start, end, period) of stretches around each middle with periods up to `most`, a whole one of which lies on one side."""
    out, begun = [], np.cumsum(most) - most
    for lo in range(0, int(most.sum()), STEP):
        flat = np.arange(lo, min(lo + STEP, int(most.sum())))
        node = np.searchsorted(begun + most, flat, "right")
        period = flat - begun[node] + 1
        a = middle[node] - (period if side < 0 else 0)
        b = a + period
        near = (ids[a] == ids[b]) | (ids[a - 1] == ids[b - 1])  # else nothing agrees; a place before the first equals nothing
        a, b, period = a[near], b[near], period[near]
        start, end = a - ranks.backwards(a - 1, b - 1), b + ranks.forwards(a, b)
        ok = end - start >= np.maximum(LEAST, TIMES * period)
        out.append(np.stack([start[ok], end[ok], period[ok]], axis=1))
    return out


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """One text's row from its runs (start, length, period)."""
    if not runs:
        return 0, None, None, None, None, _sha(b""), _sha(b" ".join(words))
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best, edge = runs[0], np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        if length * best[2] > best[1] * period:
            best = (start, length, period)
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *best, 1000 * best[1] // best[2], _sha(listed.encode()), _sha(b" ".join([words[i] for i in kept]))


def _block(texts: list[str | None]) -> list[tuple]:
    words = [(t or "").encode().split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(words)), size)
    flat = pa.array([x for w in words for x in w], pa.binary())
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, runs = np.cumsum(size) - size, [[] for _ in words]
    kept = np.flatnonzero(survivors(ids, doc))
    if len(kept):
        cuts = np.flatnonzero((np.diff(kept) > 1) | (np.diff(doc[kept]) > 0)) + 1
        begun = kept[np.append(0, cuts)]
        stretches = [ids[k] for k in np.split(kept, cuts)]
        for of, start, length, period in maximal_runs(stretches):
            at = begun[of] + start
            runs[doc[at]].append((int(at - first[doc[at]]), int(length), int(period)))
    return [_describe(w, r) for w, r in zip(words, runs, strict=True)]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the run with the greatest exponent (start, length, period, exponent_milli), and digests of all
    runs and of the text without what repeats: a word goes if it lies in a run after the run's first period."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(FOUND).fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("text"), []
            for s in passes(texts, BLOCK_BYTES):
                rows += _block(texts[s.start : s.stop].to_pylist())
            give_back()
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(search, schema)
