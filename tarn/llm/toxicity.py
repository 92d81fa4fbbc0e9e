"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is its hashed word vector beside the mean of its hashed character-trigram vectors. Two gated recurrent
units read every window of 32 words (a window begins every 24, the last one ends with the text) from both sides,
attention pools their states to one logit a window, and a text's logit is the softmax-weighted mean of its windows'
logits, which follows the most toxic window. Training is backpropagation through time, in numpy, on a bounded sample of
labelled documents; scoring reads whole texts. Labels, languages, sources and ids are no inputs of a score.

Defined results: null texts and texts without words score 0; if the labelled rows hold one class only, every text with
words scores 1 or 0 as that class; conflicting labels of one document count as toxic; rows are independent; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import ALNUM, U, Words, give_back, mix, passes, words

WINDOW, STRIDE = 32, 24
WORD_BITS, CHAR_BITS = 13, 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 8, 12, 12
#: Labelled documents of each class that training takes at most, letters of all of a class's and of one document.
SAMPLE, SAMPLE_CHARS, DOC_CHARS, EPOCHS = {1: 500, 0: 1500}, 20_000_000, 500_000, 7
#: Texts and windows that one training step takes.
STEP_TEXTS, STEP_WINDOWS = 48, 1200
#: How much a text's logit follows its most toxic windows: one among exp(6 * SHARP) windows decides it, if 6 above them.
SHARP = 3.0
#: Windows that one numpy step scores.
CHUNK = 2048

Params = dict[str, np.ndarray]


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and word count of every window."""
    count = w.counts
    n = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(w.n_docs), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(count) - count)[doc] + np.minimum(nth * STRIDE, np.maximum(count[doc] - WINDOW, 0))
    return doc, begin, np.minimum(count[doc], WINDOW)


def vocabulary(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: their word buckets, trigram buckets with each trigram's word; and each word's index."""
    _, first, index = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    # every word stands between two marks, so it has as many trigrams as bytes
    of = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]
    byte = lambda p, ok: np.where(ok, w.data[np.clip(p, 0, max(len(w.data) - 1, 0))], 1).astype(U) if len(p) else np.zeros(0, U)
    gram = byte(at - 1, at > start[of]) | byte(at, at >= 0) << U(8) | byte(at + 1, at + 1 < w.end[first][of]) << U(16)
    return (w.hash[first] >> U(64 - WORD_BITS)).astype(np.int64), (mix(gram) >> U(64 - CHAR_BITS)).astype(np.int64), of, index


def inputs(p: Params, word: np.ndarray, gram: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Word and mean character vectors of distinct words."""
    chars = np.zeros((len(word), CHAR_DIM), np.float32)
    if len(of):
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        chars[of[begin]] = np.add.reduceat(p["char"][gram], begin, axis=0) / np.diff(np.append(begin, len(of)))[:, None]
    return np.concatenate([p["word"][word], chars], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru(x: np.ndarray, index: np.ndarray, u: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
    """States by window and step; x: the words' input terms, the last row stands for no word."""
    n, steps = index.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((n, steps, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        a = x[index[:, t]]
        b = h @ u
        gate = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
        bn = b[:, 2 * HIDDEN :]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * bn)
        if keep is not None:
            keep.append((t, h, z, r, bn, c))
        h = c + z * (h - c)
        out[:, t] = h
    return out


def _gru_back(d: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the input terms and by u; d: by the states."""
    n, steps, _ = d.shape
    dx, du, dh = np.empty((n, steps, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t, h, z, r, bn, c in reversed(keep):
        dh = dh + d[:, t]
        dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
        dr = dc * bn * r * (1 - r)
        dx[:, t] = np.concatenate([dz, dr, dc], 1)
        db = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ db
        dh = dh * z + db @ u.T
    return dx, du


def _terms(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = (x @ p["in"] + p["in_bias"]).astype(np.float32)
    none = np.zeros((1, 3 * HIDDEN), np.float32)
    none[:, :HIDDEN] = 30  # no word leaves the state as it is
    return np.concatenate([both[:, : 3 * HIDDEN], none]), np.concatenate([both[:, 3 * HIDDEN :], none])


def logits(p: Params, x: np.ndarray, index: np.ndarray, state: dict | None = None) -> np.ndarray:
    """A logit for each window; index: (windows, WINDOW) rows of x, len(x) for no word."""
    ahead, back = _terms(p, x)
    kept: tuple = ([], []) if state is not None else (None, None)
    h = np.concatenate([_gru(ahead, index, p["ahead"], False, kept[0]), _gru(back, index, p["back"], True, kept[1])], axis=2)
    e = np.tanh(h @ p["attend"])
    s = e @ p["attend_out"] + np.where(index == len(x), -1e9, 0)
    weight = np.exp(s - s.max(1, keepdims=True))
    weight /= weight.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", weight, h)
    if state is not None:
        state.update(kept=kept, h=h, e=e, weight=weight, pooled=pooled)
    return pooled @ p["out"] + p["out_bias"][0]


def _index(w: Words, word_of: np.ndarray, n: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.arange(WINDOW)
    at = begin[:, None] + step
    return np.where(step < size[:, None], word_of[np.minimum(at, len(word_of) - 1)], n)


def _by_doc(logit: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' logits, and their windows' shares in them; texts without windows have -inf."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, logit)
    weight = np.exp(SHARP * (logit - top[doc]))
    weight /= np.bincount(doc, weight, n)[doc]
    total = np.bincount(doc, weight * logit, n)
    return np.where(np.isinf(top), top, total), weight


def _steps(order: np.ndarray, texts: list[list[str]]) -> Iterator[np.ndarray]:
    """Texts in this order, in steps of a bounded number of windows."""
    held, n = [], 0
    for i in order.tolist():
        if held and (len(held) == STEP_TEXTS or n + len(texts[i]) > STEP_WINDOWS):
            yield np.array(held)
            held, n = [], 0
        held.append(i)
        n += len(texts[i])
    if held:
        yield np.array(held)


def fit(texts: list[list[str]], toxic: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Params:
    """Train on documents given as lists of windows."""
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    dim = WORD_DIM + CHAR_DIM
    p = {
        "word": draw(1 << WORD_BITS, WORD_DIM, scale=0.02), "char": draw(1 << CHAR_BITS, CHAR_DIM, scale=0.1), "in": draw(dim, 6 * HIDDEN, scale=dim**-0.5), "in_bias": np.zeros(6 * HIDDEN, np.float32),
        "ahead": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "back": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "attend": draw(2 * HIDDEN, ATTEND, scale=(2 * HIDDEN) ** -0.5),
        "attend_out": draw(ATTEND, scale=ATTEND**-0.5), "out": draw(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "out_bias": np.zeros(1, np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        for part in _steps(rng.permutation(len(texts)), texts):
            rows = [t for i in part for t in texts[i]]
            doc = np.repeat(np.arange(len(part)), [len(texts[i]) for i in part])
            w = words(pa.array(rows, pa.string()), ALNUM)
            if not len(w.hash):
                continue
            word, gram, of, word_of = vocabulary(w)
            of_doc, begin, size = windows(w)
            x = inputs(p, word, gram, of)
            index = _index(w, word_of, len(x), begin, size)
            state: dict = {}
            logit = logits(p, x, index, state)
            total, weight = _by_doc(logit, doc[of_doc], len(part))
            y = toxic[part]
            error = np.where(np.isinf(total), 0, _sigmoid(total) - y) / len(part)
            d = (error[doc[of_doc]] * weight).astype(np.float32)
            g = _gradients(p, x, index, state, d, word, gram, of)
            step += 1
            lr = 0.01 / (1 + step / 400)
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= (lr * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def _gradients(p: Params, x: np.ndarray, index: np.ndarray, state: dict, d: np.ndarray, word: np.ndarray, gram: np.ndarray, of: np.ndarray) -> Params:
    h, e, weight = state["h"], state["e"], state["weight"]
    dpooled = d[:, None] * p["out"]
    dh = weight[:, :, None] * dpooled[:, None, :]
    dweight = np.einsum("nth,nh->nt", h, dpooled)
    ds = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
    de = ds[:, :, None] * p["attend_out"] * (1 - e * e)
    dh = (dh + de @ p["attend"].T).astype(np.float32)
    ahead, d_ahead = _gru_back(dh[:, :, :HIDDEN], p["ahead"], state["kept"][0])
    back, d_back = _gru_back(dh[:, :, HIDDEN:], p["back"], state["kept"][1])
    dterm = np.concatenate([ahead, back], 2).reshape(-1, 6 * HIDDEN)
    flat = index.ravel()
    real = flat < len(x)
    dterm, flat = dterm[real], flat[real]
    dterm = np.stack([np.bincount(flat, c, len(x)) for c in dterm.T], 1)  # by distinct word
    dx = dterm @ p["in"].T
    word_g, char_g = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    for j in range(WORD_DIM):
        word_g[:, j] = np.bincount(word, dx[:, j], len(word_g))
    size = np.bincount(of, minlength=len(x))
    for j in range(CHAR_DIM):
        char_g[:, j] = np.bincount(gram, (dx[:, WORD_DIM + j] / np.maximum(size, 1))[of], len(char_g))
    return {
        "word": word_g, "char": char_g, "in": x.T @ dterm, "in_bias": dterm.sum(0), "ahead": d_ahead, "back": d_back, "attend": np.einsum("nth,nta->ha", h, de),
        "attend_out": np.einsum("nta,nt->a", e, ds), "out": state["pooled"].T @ d, "out_bias": np.array([d.sum()]),
    }


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))


def text_scores(p: Params, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts, 0 to 1."""
    out = [np.zeros(0)]
    for s in passes(texts, 1 << 19):
        w = words(_lower(texts[s.start : s.stop]), ALNUM)
        if not len(w.hash):
            out.append(np.zeros(w.n_docs))
            continue
        word, gram, of, word_of = vocabulary(w)
        x = inputs(p, word, gram, of)
        doc, begin, size = windows(w)
        logit = np.concatenate([logits(p, x, _index(w, word_of, len(x), begin[i : i + CHUNK], size[i : i + CHUNK])) for i in range(0, len(doc), CHUNK)])
        total, _ = _by_doc(logit.astype(float), doc, w.n_docs)
        out.append(np.where(np.isinf(total), 0.0, _sigmoid(total)))
    return np.concatenate(out)


def toxicity(text: Column, p: Params) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(text_scores(p, texts))
        give_back()
        return out

    return score(text)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, rows = [], []
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
            w = words(_lower(pa.array([text.as_py()], pa.string())), ALNUM)
            _, begin, size = windows(w)
            raw = w.data.tobytes()
            rows.append([raw[w.start[b] : w.end[b + n - 1]].decode() for b, n in zip(begin.tolist(), size.tolist(), strict=True)])
            toxic.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["toxic", "windows"])


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Params | float:
    """Parameters, or the one score that all texts get if only one class is labelled.

    `labels` (doc_id, toxic) must hold the training rows only. Of each class at most `sample` documents of at most DOC_CHARS
    letters are taken, in the order of a hash of their id, until SAMPLE_CHARS; all windows of these are learnt from.
    Rows that repeat an id are taken once each, in the order of their texts, while there is room.
    """
    sample = sample or SAMPLE
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64(F.col("doc_id"), F.lit(3)), F.col("doc_id"))
    chosen = [known.filter(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in sample.items()]
    found = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").filter(F.char_length("text") <= DOC_CHARS)
    sizes = found.select("toxic", "doc_id", F.char_length("text").alias("chars"), F.xxhash64("text").alias("which")).dropDuplicates(["doc_id", "which"])
    w = Window.partitionBy("toxic").orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id", "which")  # a few thousand slim rows
    sizes = sizes.withColumns({"sum": F.sum("chars").over(w), "nth": F.row_number().over(w)})
    most = F.create_map(*(F.lit(x) for pair in sample.items() for x in pair))[F.col("toxic")]
    fits = sizes.filter((F.col("sum") <= SAMPLE_CHARS) & (F.col("nth") <= most)).select("doc_id", "which")
    texts = found.withColumn("which", F.xxhash64("text")).join(F.broadcast(fits), ["doc_id", "which"]).dropDuplicates(["doc_id", "which"])
    rows = texts.select("toxic", "text").mapInArrow(_windows, "toxic int, windows array<string>").collect()
    rows = sorted((int(r["toxic"]), list(r["windows"])) for r in rows if r["windows"])
    classes = {t for t, _ in rows}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.0
    return fit([x for _, x in rows], np.array([t for t, _ in rows]))


def score_texts(docs: DataFrame, model: Params | float, to: str = "score") -> DataFrame:
    """`docs` with the score of `text` in `to`, which replaces a column of that name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if isinstance(model, float):
        return docs.withColumn(to, F.when(F.regexp_like(text, F.lit(r"[\p{L}\p{N}]")), F.lit(model)).otherwise(F.lit(0.0)))
    return docs.withColumn(to, toxicity(text, model))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
