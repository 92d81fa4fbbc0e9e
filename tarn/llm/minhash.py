"""Near-duplicates by Order MinHash, verified by banded alignment.

Texts are sequences of lower-case words between white space. A sketch coordinate takes, under its own hash, the two smallest of
a text's 5-word shingles, each labelled with its occurrence, and keeps them in the order of the text, so it compares
order as well as content. Two coordinates make a band; texts that share a band are candidates.

Similarity is the share of 5-word shingles that an alignment matches in order: with M matched of m and n,
M / (m + n - M), the shingles' Jaccard similarity for texts whose passages keep their order. Links need 0.8 or more. The
alignment is the longest common subsequence of the shingle sequences after trimming common ends, bit-parallel, within
the band outside of which no alignment could reach the threshold.

No pair of a bucket's members is emitted wholesale. Equal texts collapse to one node first. Each bucket has a head, the
member that shares buckets with most others; first, members are verified against their heads only, and links give
components. Then, where the members of a head's buckets still fall into several components, they are compared across
components inside blocks: a product of incidence matrices counts the shingles that each pair shares, pairs that
reach the threshold are aligned, and a block reports no more links than join its components.

Defined results: null texts are empty; texts without words are each a class of their own; texts of fewer than five
words have one shingle of all of them; equal texts with words share a class; rows that repeat id and text are
copies of each other; a class is named by its smallest id (null if no row has one); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import cut, folded, joined, table
from .words import BASE, SPACED, U, give_back, mix, occurrences, passes, shingles, words

K, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 2
COORDINATES = BANDS * ROWS
#: Shingles of a head's members, and members, that one block holds.
BLOCK, BLOCK_MEMBERS = 200_000, 768

_seeds = np.random.default_rng(7)
ODD = _seeds.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
ADD = _seeds.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (32-bit coordinates) of lower-case texts, and their numbers of shingles."""
    gram, doc, _ = shingles(words(texts, SPACED), K)
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), COORDINATES), np.int32)
    if not len(gram):
        return out, n
    labelled = mix(gram ^ (occurrences(doc, gram).astype(U) * BASE))
    begin = (np.cumsum(n) - n)[n > 0]
    count = n[n > 0]
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(gram))
    top = U(0xFFFFFFFFFFFFFFFF)
    for c in range(COORDINATES):
        x = labelled * ODD[c] + ADD[c]
        x ^= x >> U(32)
        low = np.minimum.reduceat(x, begin)
        is_low = x == low[row]
        first = np.minimum.reduceat(np.where(is_low, at, len(at)), begin)
        x[first] = top
        low2 = np.minimum.reduceat(x, begin)
        second = np.minimum.reduceat(np.where(x == low2[row], at, len(at)), begin)
        a, b = labelled[np.minimum(first, second)], labelled[np.maximum(first, second)]
        pair = np.where(count > 1, mix(a + mix(b)), mix(labelled[first]))
        out[n > 0, c] = (pair >> U(32)).astype(np.uint32).view(np.int32)
    return out, n


SKETCHED = "doc_id long, node binary, n int, sketch array<int>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        texts = _lower(batch.column("text"))
        for s in passes(texts, 1 << 20):
            nodes = batch.column("node")[s.start : s.stop]
            fresh = []
            for i, x in enumerate(nodes.to_pylist()):
                if x not in seen:  # copies in one task are sketched once
                    fresh.append(i)
                    seen.add(x)
            if len(seen) > 100_000:
                seen.clear()
            rows = np.array(fresh, np.int64)
            got, n = sketches(texts[s.start : s.stop].take(pa.array(rows)))
            where = np.full(len(nodes), -1)
            where[rows[n > 0]] = np.flatnonzero(n > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(where >= 0, COORDINATES, 0))]), pa.int32()), pa.array(got[where[where >= 0]].ravel()), mask=pa.array(where < 0))
            count = pa.array(np.where(where >= 0, n[where] if len(n) else 0, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s.start : s.stop], nodes, count, lists], names=["doc_id", "node", "n", "sketch"])
        give_back()


def common(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence, or less than `least` if it is less than that."""
    m, n = len(a), len(b)
    short = min(m, n)
    if short < least:
        return 0
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if not short:
        return head
    same = a[::-1][:short] == b[::-1][:short]
    tail = short if same.all() else int(same.argmin())
    if tail:
        a, b = a[:-tail], b[:-tail]
    both = head + tail
    if not len(a) or not len(b):
        return both
    # An alignment that leaves d symbols of one side unmatched strays d places at most from the diagonal.
    band = max(len(a), len(b)) - max(0, least - both)
    if band < 0:
        return both
    position: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        position[x] = position.get(x, 0) | 1 << i
    v = (1 << len(a)) - 1  # zero bits: places of a where the subsequence grows
    bs = b.tolist()
    step = max(256, band)
    for j in range(0, len(bs), step):
        low, high = max(0, j - band), min(len(a), j + step + band)
        if low >= high:
            continue
        full = (1 << (high - low)) - 1
        part = v >> low & full
        for x in bs[j : j + step]:
            match = position.get(x)
            if match is not None:
                match = match >> low & full
                hit = part & match
                part = (part + hit | part & ~match) & full
        v = v & ~(full << low) | part << low
    return both + len(a) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned similarity of two shingle sequences; 0 if it is below the threshold."""
    total = len(a) + len(b)
    least = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    got = common(a, b, least)
    return got / (total - got) if got >= max(1, least) else 0.0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its shingles in order, and its shingles labelled with their occurrence, sorted."""
    gram, doc, _ = shingles(words(pa.array(texts, pa.large_string()), SPACED), K)
    labelled = mix(gram ^ (occurrences(doc, gram).astype(U) * BASE))
    edges = np.searchsorted(doc, np.arange(1, len(texts)))
    return [(g, np.sort(x)) for g, x in zip(np.split(gram, edges), np.split(labelled, edges), strict=True)] if texts else []


VERIFIED = "a binary, b binary, similarity double, jaccard double"


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [part.column(c).to_pylist() for c in ("a", "b")]
                texts = [_lower(part.column(c)) for c in ("text_a", "text_b")]
                held = {x: held[x] for x in set(ids[1]) & held.keys()}  # rows come by b: its texts come again
                need: dict[bytes, str] = {}
                for nodes, column in zip(ids, texts, strict=True):
                    for r, x in enumerate(nodes):
                        if x not in held and x not in need:
                            need[x] = column[r].as_py()
                held |= dict(zip(need, _grams(list(need.values())), strict=True))
                content = [jaccard(held[x][1], held[y][1]) for x, y in zip(*ids, strict=True)]
                aligned = [similarity(held[x][0], held[y][0], threshold) if j >= threshold - 1e-9 else 0.0 for x, y, j in zip(*ids, content, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(aligned, pa.float64()), pa.array(content, pa.float64())], names=["a", "b", "similarity", "jaccard"])
            give_back()

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`pairs` (a, b) with their aligned similarity, 0 below the threshold, and their shingles' Jaccard similarity."""
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify(threshold), VERIFIED)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sorted sets has in common."""
    every = np.concatenate([*left, *right])
    value, count = np.unique(every, return_counts=True)
    value = value[count > 1]  # the others are in one set only
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets)
        col = np.minimum(np.searchsorted(value, flat), max(len(value) - 1, 0))
        ok = value[col] == flat if len(value) else np.zeros(len(flat), bool)
        return row[ok], col[ok]

    (lr, lc), (rr, rc) = places(left), places(right)
    for c in range(0, len(value), 4096):
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        for m, r, k in ((x, lr, lc), (y, rr, rc)):
            ok = (k >= c) & (k < c + 4096)
            m[r[ok], k[ok] - c] = 1
        out += x @ y.T
    return out


def _across(threshold: float):
    """Links of one head's members across components; rows come sorted by head and block pair.

    Side 0 rows are compared with side 1 rows, or, where both blocks are the same, with each other.
    """

    def compare(held: list[tuple]) -> list[tuple[bytes, bytes]]:
        parent = {h[1]: h[1] for h in held}
        if len(parent) < 2:
            return []

        def root(x: bytes) -> bytes:
            while parent[x] != x:
                x = parent[x]
            return x

        grams = _grams(_lower(pa.array([h[4] for h in held], pa.string())).to_pylist())
        side, near = np.array([h[2] for h in held]), np.array([h[3] for h in held])
        kind = np.unique(np.array([h[1] for h in held], object), return_inverse=True)[1]
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(held)),) * 2
        size = np.array([len(g[1]) for g in grams])
        out = []
        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            both = shared_counts([grams[r][1] for r in rows], [grams[r][1] for r in right])
            share = both / (size[rows][:, None] + size[right][None, :] - both)
            ok = (share >= threshold - 1e-6) & (kind[rows][:, None] != kind[right][None, :])
            ok &= np.abs(near[rows][:, None] - near[right][None, :]) <= 1 - threshold + 1e-6
            x, y = np.nonzero(ok)
            for p, q in zip(*(v[np.argsort(-share[x, y], kind="stable")].tolist() for v in (x, y)), strict=True):
                a, b = held[rows[p]], held[right[q]]
                if root(a[1]) != root(b[1]) and similarity(grams[rows[p]][0], grams[right[q]][0], threshold):
                    parent[root(a[1])] = root(b[1])
                    out.append((a[0], b[0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if found := compare(held):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = zip(*(part.column(c).to_pylist() for c in ("head", "i", "j")), strict=True)
                rows = zip(*(part.column(c).to_pylist() for c in ("node", "component", "side", "near", "text")), strict=True)
                for key, row in zip(keys, rows, strict=True):
                    if key != now:
                        yield from flush()
                        now, held = key, []
                    held.append(row)
        yield from flush()
        give_back()

    return run


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text) and, once a task, n and sketch of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text")).mapInArrow(_sketch, SKETCHED)


def links(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: verified links between different texts; their components are the classes."""
    nodes = rows.filter("sketch is not null").dropDuplicates(["node"]).select("node", "n", "sketch")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *(F.get(F.col("sketch"), b * ROWS + r) for r in range(ROWS)))))
    members = cut(nodes.select("node", band.alias("bucket")))
    counts = members.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut(joined(members, cut(counts), "bucket", "members"))  # of buckets with several members
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = members.join(weight, "node")
    heads = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("head"), F.count("*").alias("members"))
    members = cut(joined(members.select("node", "bucket"), cut(heads), "bucket", "members"))
    # first round: each text with the heads of its buckets
    pairs = members.filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    named = members.select("node").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    texts = table(hashed.join(named, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    first = cut(verified(pairs, texts, threshold))
    linked = first.filter("similarity > 0")
    component = connected(linked)
    # second round: members of one head that are in several components
    near = first.select(F.col("a").alias("node"), F.col("b").alias("head"), F.col("jaccard").alias("near"))
    near = near.union(near.select(F.col("head").alias("node"), "head", F.lit(1.0)).distinct())
    placed = near.join(component, "node", "left").select("node", "head", "near", F.coalesce("component", "node").alias("component")).join(nodes.select("node", "n"), "node")
    # The members of a head's largest component need not meet each other: they have blocks of their own behind those of the rest.
    sizes = placed.groupBy("head", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    whole = sizes.groupBy("head").agg(F.count("*").alias("components"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.max(F.struct("members", "component", "shingles")).alias("top"))
    many = lambda members, n: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK, members / BLOCK_MEMBERS))).cast("int")
    mixed = whole.filter("components > 1").select(
        "head", F.col("top.component").alias("largest"), many(F.col("members") - F.col("top.members"), F.col("shingles") - F.col("top.shingles")).alias("rest"), many(F.col("top.members"), F.col("top.shingles")).alias("most")
    )
    in_largest = F.col("component") == F.col("largest")
    part = F.when(in_largest, F.col("rest") + F.pmod(F.xxhash64("node"), F.col("most"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    last = F.when(in_largest, F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    dealt = placed.join(mixed, "head").select("head", "node", "component", "near", part.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other")).join(texts, "node")
    dealt = dealt.select("head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", (F.col("own") > F.col("other")).cast("int").alias("side"), "near", "text")
    second = dealt.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j").mapInArrow(_across(threshold), "a binary, b binary")
    return linked.select("a", "b").union(cut(second))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node and class of every row; class is null where a row has no copies and no links."""
    rows = cut(sketched(docs))
    component = connected(links(docs, rows, threshold))
    # a node without words is told by its sketch: no row of it has one
    worded = rows.groupBy("node").agg(F.max("n").alias("words"), F.count("*").alias("copies"))
    own = F.when(F.col("words") > 0, F.coalesce("component", "node"))
    named = cut(worded.join(component, "node", "left").select("node", own.alias("class"), "copies"))
    return joined(rows.select("doc_id", "node"), named, "node", "copies")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the smallest id of its class) of every row."""
    placed = cut(classes(docs, threshold))
    least = cut(placed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")))
    known = joined(placed.filter("class is not null"), least, "class", "members").select("doc_id", "class_id")
    return known.union(placed.filter("class is null").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class: that of the smallest id, and of the smallest digest among its rows."""
    placed = cut(classes(docs, threshold).filter("class is not null"))
    size = placed.groupBy("class").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("kept"))
    # rows that go: all of larger classes but the kept one; rows equal to it in id and text leave one
    kept = cut(size.filter("rows > 1").select("class", F.col("kept.doc_id").alias("k_id"), F.col("kept.node").alias("k_node"), F.col("rows").alias("members")))
    gone = joined(placed, kept, "class", "members").groupBy("doc_id", "node").agg(F.max((F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("node") == F.col("k_node"))).cast("int")).alias("__stays"), F.count("*").alias("rows"))
    gone = cut(gone).select(F.col("doc_id").alias("__g_id"), F.col("node").alias("__g_node"), "__stays", F.col("rows").alias("__g_rows"))
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    slim, column = folded(docs, "doc_id", "text")
    kept_columns = [column(c) for c in docs.columns]
    found = slim.withColumn("__node", node).join(gone, (F.col("__node") == F.col("__g_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__g_id")), "left")
    single = found.filter("__stays is null or (__stays = 1 and __g_rows = 1)").select(*kept_columns)
    if gone.filter("__stays = 1 and __g_rows > 1").isEmpty():
        return single
    repeated = found.filter("__stays = 1 and __g_rows > 1").dropDuplicates(["__node"]).select(*kept_columns)
    return single.union(repeated)
