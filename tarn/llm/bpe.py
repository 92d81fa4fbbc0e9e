"""Byte-level BPE encoding and decoding with a rank file.

Encoding merges through a hierarchical-bitmap rank queue. One bucket per merge rank holds the linked-list positions
of the pairs with that rank; three levels of 64-bit words tell which buckets have entries, so find-first-set gives
the lowest rank in three steps; entries whose pair has changed since are skipped when their bucket comes up. All new
pre-tokens of a block share one linked list: no pair crosses from one to the next, and the order of ranks within
each is the order of ranks of all, so a bucket is merged in one numpy step. A pre-token of any length costs
time in proportion to its merges.

Defined results: null and empty texts have no ids and decode to no bytes; null ids decode to null; rows are
independent, repeated rows repeat their result, other columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import give_back, passes

#: Distinct pre-tokens that a worker remembers; beyond it, it starts anew. Bounds memory, not the result.
REMEMBERED = 200_000
#: Bytes of new pre-tokens that one queue holds, unless one pre-token alone is longer.
QUEUE_BYTES = 3 << 19
#: Bytes of text that are split at once, unless one text alone is longer.
TEXT_BYTES = 4 << 20


class BitmapQueue:
    """Buckets by rank under three levels of 64-bit occupancy words."""

    def __init__(self, n: int):
        self.buckets: list[list | None] = [None] * n
        self.levels = []
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n <= 1:
                break

    def push(self, rank: int, entry: int) -> None:
        b = self.buckets[rank]
        if b is not None:
            b.append(entry)
            return
        self.buckets[rank] = [entry]
        self.mark(rank)

    def mark(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                break
            level[word] |= bit
            rank = word

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank that has entries, and all of them."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | ((word & -word).bit_length() - 1)
        rank, out = at, self.buckets[at]
        self.buckets[at] = None
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return rank, out


class Ranks:
    """A rank file as tables: ids of bytes, ranks of pairs of ids, bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.size = max(self.ids.values()) + 1
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        by_id = sorted((i, t) for t, i in self.ids.items())
        lengths = np.zeros(self.size, np.int64)
        lengths[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours; `size` if they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(self.size))


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def merge(table: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each piece has."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    symbol = table.byte[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
    n, none = len(symbol), table.size
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    rank = np.full(n + 1, none, np.int32)
    if n > 1:
        rank[: n - 1] = np.where(piece[1:] == piece[:-1], table.pair(symbol[:-1], symbol[1:]), none)
    queue = BitmapQueue(none)
    # the pairs of the text as it stands go in as whole arrays
    order = np.flatnonzero(rank[:n] < none)
    order = order[np.argsort(rank[order], kind="stable")]
    first_ranks, edges = np.unique(rank[order], return_index=True)
    begin = dict(zip(first_ranks.tolist(), np.split(order, edges[1:]), strict=True)) if len(order) else {}
    for r in begin:
        queue.buckets[r] = []
        queue.mark(r)
    alive = np.ones(n, bool)
    while got := queue.pop():
        now, entries = got
        at = begin.pop(now, None)
        if entries:
            at = np.array(entries, np.int64) if at is None else np.concatenate([at, entries])
            at.sort()
            at = at[rank[at] == now]  # the others are stale
            if len(at) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        else:
            at = at[rank[at] == now]
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1 and (overlap := right[:-1] == at[1:]).any():
            keep = np.ones(len(at), bool)  # of overlapping pairs, the leftmost goes first
            for i in np.flatnonzero(overlap).tolist():
                if keep[i]:
                    keep[i + 1] = False
            at, right = at[keep], right[keep]
        symbol[at] = now
        follow = after[right]
        after[at] = follow
        alive[right] = False
        rank[right] = none
        linked = follow < n
        before[follow[linked]] = at[linked]
        lead = before[at]
        lead = lead[lead >= 0]
        first = np.concatenate([at, lead])
        second = after[first]
        rank[first] = none
        ok = second < n
        first, second = first[ok], second[ok]
        ok = piece[first] == piece[second]
        first, second = first[ok], second[ok]
        if len(first):
            new = table.pair(symbol[first], symbol[second])
            rank[first] = new
            ok = new < none
            for r, p in zip(new[ok].tolist(), first[ok].tolist(), strict=True):
                queue.push(r, p)
    return symbol[alive], np.bincount(piece[alive], minlength=len(pieces))


class Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """Ids of pre-tokens, each encoded once while it is remembered."""

    def __init__(self, path: str, pattern: str):
        self.table, self.pattern = ranks(path), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.index = Numbers()
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, fresh: list[str]) -> None:
        got_ids, got_lengths = [], []
        i = 0
        while i < len(fresh):
            part, size = [], 0
            while i < len(fresh) and (not part or size + 4 * len(fresh[i]) <= QUEUE_BYTES):
                part.append(fresh[i].encode("utf-8", "surrogatepass"))
                size += len(part[-1])
                i += 1
            whole = [self.table.ids.get(p) for p in part]
            ids, lengths = merge(self.table, [b"" if w is not None else p for p, w in zip(part, whole, strict=True)])
            known = np.array([w is not None for w in whole], bool)
            if known.any():  # a pre-token that is itself in the vocabulary is one token, whatever its merges
                at = (np.cumsum(lengths) - lengths)[known]
                ids = np.insert(ids, at, np.array([w for w in whole if w is not None], np.int64))
                lengths = np.where(known, 1, lengths)
            got_ids.append(ids.astype(np.int32))
            got_lengths.append(lengths)
        lengths = np.concatenate(got_lengths)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *got_ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.index) > REMEMBERED:
            self.forget()
        number, find, known = self.index.__getitem__, self.pattern.findall, len(self.index)
        at, sizes = [], []
        for t in texts:
            pieces = find(t)
            at.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
            sizes.append(len(pieces))
        fresh = list(islice(reversed(self.index), len(self.index) - known))[::-1]
        if fresh:
            self.learn(fresh)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        out = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        return out, np.diff(edges)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_texts(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    coder = encoder(path, pattern)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for s in passes(texts, TEXT_BYTES):
        i, c = coder.encode(texts[s.start : s.stop].fill_null("").to_pylist())
        ids.append(i)
        counts.append(c)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)))


def decode_ids(column: pa.Array, path: str) -> pa.Array:
    table, out = ranks(path), []
    for i in range(0, len(column), 256):
        part = column[i : i + 256]
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        lengths = table.lengths[flat]
        ends = np.cumsum(lengths)
        raw = table.bytes[np.repeat(table.starts[flat] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        valid = part.is_valid().to_pylist()
        out.append(pa.array([raw[a:b] if ok else None for a, b, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), valid, strict=True)], pa.binary()))
    give_back()
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """array<int> of the ids of a text column."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_texts(texts, path, pattern)

    return encode(text)


def token_bytes(ids: Column, path: str) -> Column:
    """The bytes that a column of ids stands for."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        return decode_ids(column, path)

    return decode(ids)


def there_and_back(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, decoded>: the ids of a text column, and the bytes that these ids stand for, by one pass of Python."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def run(texts: pa.Array) -> pa.Array:
        ids = encode_texts(texts, path, pattern)
        return pa.StructArray.from_arrays([ids, decode_ids(ids, path)], names=["ids", "decoded"])

    return run(text)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", to: str = "ids") -> DataFrame:
    """`docs` with the ids of `column` in `to`, which replaces a column of that name."""
    return docs.withColumn(to, token_ids(F.coalesce(F.col(column), F.lit("")), path, pattern))


def decode(docs: DataFrame, path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """`docs` with the bytes of the ids of `column` in `to`."""
    # A Python function directly on another's result would run both together, and the other twice.
    given = F.when(F.size(column) >= 0, F.col(column))
    return docs.withColumn(to, token_bytes(given, path))


def round_trip(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """`docs` with ids and decoded, which replace columns of these names."""
    made = there_and_back(F.coalesce(F.col(column), F.lit("")), path, pattern)
    others = [c for c in docs.columns if c not in ("ids", "decoded")]
    return docs.withColumn("__made", made).select(*others, "__made.ids", "__made.decoded")
