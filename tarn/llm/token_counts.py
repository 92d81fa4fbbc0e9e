"""Token counts of a piece vocabulary, from distinct pre-tokens.

The pieces of `piece_bpe_32k.model` never hold a space mark after another character, so no merge crosses from a
character to a following space: a text falls into pre-tokens (a run of spaces and what follows it) that are
encoded apart without changing the sum. Each block of documents counts pieces once per distinct pre-token, joins
those counts to the per-document frequencies and sums; no document's ids are made, those of a new pre-token only while it is counted.

Defined results: null and empty texts have 0 tokens; rows are independent, so repeated rows repeat their result and
other columns are not touched; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import give_back, passes

#: The mark that the library writes for a space.
MARK = "▁"
#: Distinct pre-tokens that a worker remembers; beyond it, it starts anew. Bounds memory, not the result.
REMEMBERED = 300_000


@functools.lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def check_model(path: str) -> None:
    """Fail if a piece would let a merge cross a pre-token's start."""
    sp = _processor(path)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"{path}: piece {i} holds a space mark inside; its pre-tokens can't be counted apart")


PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")

_known: dict[str, dict[str, int]] = {}


def _count_new(path: str, fresh: list[str]) -> None:
    sp = _processor(path)
    # The library puts a mark of its own in front of every text, so a pre-token loses one before it is encoded.
    ids = sp.encode([p[1:].replace(MARK, " ") for p in fresh], num_threads=1)
    # A mark alone would be the empty text: it is a piece, or falls to its three bytes.
    alone = 1 if sp.piece_to_id(MARK) != sp.unk_id() else 3
    for p, x in zip(fresh, ids, strict=True):
        _known[path][p] = alone if p == MARK else len(x)


def _block(path: str, texts: list[str]) -> list[int]:
    frequencies = []
    for t in texts:
        # most texts have single spaces only: a plain split gives the pre-tokens without their mark
        t = MARK + t.replace(" ", MARK) if t else ""
        if MARK * 2 in t or t.endswith(MARK):
            frequencies.append(Counter(PRETOKEN.findall(t)))
        else:
            frequencies.append(Counter([MARK + x for x in t[1:].split(MARK)]) if t else Counter())
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    fresh = list({p for f in frequencies for p in f if p not in known})
    if fresh:
        _count_new(path, fresh)
    return [sum(known[p] * n for p, n in f.items()) for f in frequencies]


def piece_count(text: Column, path: str) -> Column:
    """Number of pieces of a text column."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        check_model(path)
        out: list[int] = []
        for s in passes(texts):
            out += _block(path, texts[s.start : s.stop].fill_null("").to_pylist())
        give_back()
        return pa.array(np.array(out, np.int64))

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), piece_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
