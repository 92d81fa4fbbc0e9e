"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial hash and of the finaliser.
BASE, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text that one numpy pass takes; a longer text makes a pass of its own.
PASS_BYTES = 1 << 20

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])

_powers: list[np.ndarray] = []


def give_back() -> None:
    """Return freed memory to the system: a worker goes on to other operators, beside which its peak should not stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PASS_BYTES + 1)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(n - 1, x, U)]), dtype=U) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows with at most `limit` bytes of text, or one row."""
    _, off = text_buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield slice(i, j)
        i = j


@dataclass
class Words:
    n_docs: int
    doc: np.ndarray  # index of each word's text
    start: np.ndarray  # byte positions in the pass
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(texts: pa.Array, kinds: np.ndarray = SPACED) -> Words:
    data, off = text_buffers(texts)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kinds[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    first[cuts] = inside[cuts]
    last = inside[:n] & ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:n], out=prefix[1:])
    hashed = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * MIX2)
    doc = np.searchsorted(off, start, "right") - 1
    return Words(len(off) - 1, doc, start, end, hashed, data, off)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, the text of each, and the index of its first word.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    n = len(w.hash)
    count = w.counts
    left = np.repeat(np.cumsum(count), count) - np.arange(n)  # words from here to the text's end
    size = np.minimum(count[w.doc], k) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(left >= size)
    out = np.zeros(len(at), U)
    for j in range(k):
        ok = j < size[at]
        term = w.hash[np.minimum(at + j, n - 1)] if n else out
        out = out * BASE + np.where(ok, term, U(0))
    return mix(out), w.doc[at], at


def occurrences(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each value was seen before in its text."""
    n = len(value)
    key = mix(value ^ (doc.astype(U) * BASE))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(fresh)
    seen = np.empty(n, np.int64)
    seen[order] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return seen
