"""Near-duplicates, repeated passages and nearest neighbours against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import ann, components, minhash, substring
from tarn.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(3, 9))) for _ in range(3000)]


def prose(n, r=R):
    return [r.choice(VOCABULARY) for _ in range(n)]


def edited(words, n, r=R):
    out = list(words)
    for _ in range(n):
        i = r.randrange(len(out))
        kind = r.random()
        if kind < 0.4:
            out[i] = r.choice(VOCABULARY)
        elif kind < 0.7:
            out.insert(i, r.choice(VOCABULARY))
        elif len(out) > 1:
            del out[i]
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = [0]
        for j, y in enumerate(b):
            last.append(row[j] + 1 if x == y else max(row[j + 1], last[j]))
        row = last
    return row[-1]


def brute_similarity(a, b):
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    x, y = grams(a), grams(b)
    n = lcs(x, y)
    return n / (len(x) + len(y) - n) if x and y else 0.0


def brute_classes(texts):
    words = [(t or "").lower().split() for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if words[i] and words[j] and root(i) != root(j) and (texts[i] == texts[j] or brute_similarity(words[i], words[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


def fixture_texts():
    texts = []
    for n in (12, 40, 90, 150):
        base = prose(n)
        texts.append(" ".join(base))
        texts += [" ".join(edited(base, k)) for k in (1, 1, 2, 3, 5, 8, n // 3)]
        texts.append(" ".join(base).upper())
        texts += [" ".join(base)] * 2
    chain = prose(120)
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = edited(chain, 2)
    shared = prose(30)
    texts += [" ".join(prose(40) + shared + prose(40)) for _ in range(8)]
    texts += ["", None, " \n", "one", "one", "one two three", "one two three", "One Two three", "a b c d e", "la " * 200, "la " * 199]
    texts += [" ".join(prose(60)) for _ in range(10)]
    return texts


def test_classes_equal_brute_force(spark):
    texts = fixture_texts()
    df = spark.createDataFrame([(i, t, "n", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, stays string, of double")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_hot_group_of_near_copies(spark):
    """Variants that are near the common text but not near each other."""
    base = prose(120)
    texts = [" ".join(base)] * 5 + [" ".join(edited(base, 3)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    near = [i for i, t in enumerate(texts) if brute_similarity(t.split(), base) >= 0.8]
    assert all(got[i] == 0 for i in near) and len(near) > 100


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "other words that nobody else has at all"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([("None", "7")] * 2 + [("7", "7")] * 2 + [("None", "None"), ("3", "3")])
    assert sorted(str(r.doc_id) for r in minhash.keep_one(df).collect()) == ["3", "7", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_one(df.limit(0)).count() == 0


def test_alignment_is_exact():
    r = random.Random(3)
    for _ in range(500):
        a = [r.randint(0, r.choice([3, 50])) for _ in range(r.randint(1, 50))]
        b = edited([str(x) for x in a], r.randint(0, 10), r)
        a, b = np.array([hash(str(x)) for x in a]), np.array([hash(x) for x in b])
        n = lcs(a.tolist(), b.tolist())
        want = n / (len(a) + len(b) - n)
        got = minhash.similarity(a, b)
        assert (got > 0) == (want >= 0.8 - 1e-12) and (got == 0 or abs(got - want) < 1e-12)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 60)] + [(70, 70), (80, 81)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)} | {80: 80, 81: 80}


def test_planted_passages(spark):
    r = random.Random(9)
    rows, planted = [], []
    for p in range(12):
        passage = prose(r.randrange(55, 140), r)
        for c in range(r.randrange(2, 6)):
            copy = edited(passage, 0 if p % 2 == 0 else len(passage) // 30, r)
            front, back = prose(r.randrange(0, 200), r), prose(r.randrange(0, 200), r)
            rows.append((len(rows), " ".join(front) + ("\n" if front else "") + " ".join(copy) + " " + " ".join(back)))
            planted.append((p, len(front), len(front) + len(copy)))
    clean = [(1000 + i, " ".join(prose(300, r))) for i in range(10)]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows + clean + [(2000, None), (2001, ""), (2002, "short")]], "doc_id long, text string, n_chars long, ord string")
    got = substring.repeated_passages(df).collect()
    texts = dict(rows)
    hit = {}
    for x in got:
        assert x.doc_id < 1000 and x.of_doc_id < x.doc_id and x.similarity >= 0.8
        assert planted[x.doc_id][0] == planted[x.of_doc_id][0]
        words = texts[x.doc_id].split()[x.start_word : x.end_word]
        assert texts[x.doc_id][x.start_char : x.end_char].split() == words and len(words) >= 50
        hit.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
    for i, (p, s, e) in enumerate(planted):
        if any(q == p for q, _, _ in planted[:i]):
            assert len(hit.get(i, set()) & set(range(s, e))) >= 0.85 * (e - s), (i, p)
            assert len(hit[i] - set(range(s, e))) <= 6
    out = {x.doc_id: x for x in substring.cut_passages(df).collect()}
    assert len(out) == df.count()
    for i, t in clean:
        assert out[i].text == t and out[i].n_chars == 0
    for i, t in rows:
        keep = [w for j, w in enumerate(t.split()) if j not in hit.get(i, set())]
        assert (out[i].text or "").split() == keep
        assert i not in hit or out[i].n_chars == len(out[i].text)


def test_passage_in_very_many_documents(spark):
    passage = " ".join(prose(60))
    rows = [(i, " ".join(prose(30)) + " " + passage + " " + " ".join(prose(30))) for i in range(300)]
    rows += [(None, "x " + passage), (None, "x " + passage), (5, rows[5][1])]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 300)) | {None}
    assert len(got) <= 2 * 303


def test_no_passages(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.repeated_passages(df).count() == 0 and substring.cut_passages(df).count() == 0


def brute_nearest(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[np.flatnonzero(ids == q)[0]]
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
        out[q] = order[:k]
    return out


@pytest.mark.parametrize("block", [4096, 32])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = df.toPandas()
    x, ids = np.stack(pdf.embedding.values).astype(float), pdf.vec_id.values
    want = brute_nearest(ids, x, [i for i in ids if i % 5 == 0])
    got = ann.nearest(df, F.col("vec_id") % 5 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert np.mean([(q, i) in found for q, rows in want.items() for _, i in rows]) >= 0.9
    score = {(q, i): -s for q, rows in want.items() for s, i in rows}
    for r in got:
        assert (r.query_id, r.vec_id) not in score or abs(score[r.query_id, r.vec_id] - r.score) < 1e-12
    assert max(r["rank"] for r in got) == 5


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1e-200, 0.0, 0.0]), (9, [-1.0, 0.5, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [1.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(df, F.col("vec_id").isin(0, 3, 4)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 9)]
    assert got[0].score == 1.0
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_few_candidates_are_all_found(spark):
    x = np.random.default_rng(3).standard_normal((5, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 2).collect()
    want = brute_nearest(np.arange(5), x, [0, 1])
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted((q, n + 1, i) for q, w in want.items() for n, (_, i) in enumerate(w))


def test_repeated_vector_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(1000, [1.0, 2.0, 3.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 1000, k=3).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 0), (2, 1), (3, 2)]


@pytest.mark.parametrize("name", ["op4_nearest", "op7_near_duplicates", "op10_repeated_passages"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_passage_whose_parts_are_common(spark):
    r = random.Random(21)
    a, b = prose(40, r), prose(40, r)
    text = lambda *parts: " ".join(w for part in (prose(30, r), *parts, prose(30, r)) for w in part)
    rows = [text(*([a], [b], [a, prose(30, r), b])[i % 3]) for i in range(30)]
    rows[10] = text(a, b)
    rows.append(text(a, b))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(x.doc_id, x.of_doc_id): set(range(x.start_word, x.end_word)) for x in substring.repeated_passages(df).collect()}
    assert set(range(30, 110)) <= got.get((30, 10), set())


def test_fuzzy_passages(spark):
    r = random.Random(22)
    rows, planted = [], []
    for p in range(100):
        passage = prose(60, r)
        other = list(passage)
        for i in r.sample(range(1, 59), 8):
            other[i] = f"changed{p}x{i}"
        for words in (passage, other):
            rows.append((len(rows), " ".join(prose(40, r) + words + prose(40, r))))
        planted.append(len(rows) - 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in substring.repeated_passages(df).collect() if x.of_doc_id == x.doc_id - 1}
    assert len(got & set(planted)) >= 90


def test_occurrences_beyond_256_keep_their_numbers():
    n = 700
    hashed, ord_ = np.full(2 * n, 7, np.uint64), np.repeat([1, 2], n).astype(np.int64)
    key, pos = np.zeros(2 * n, np.int64), np.tile(np.arange(n, dtype=np.int32) * 9, 2)
    shuffled = np.random.default_rng(3).permutation(2 * n)
    links, found, _ = substring.linked(*(c[shuffled] for c in (hashed, ord_, key, pos)))
    assert len(found[0]) == 2 * n and sorted(zip(links[2].tolist(), links[5].tolist(), strict=True)) == [(9 * i, 9 * i) for i in range(n)]


def brute_repeats(texts):
    """Words of each document that lie in LEAST_WORDS words in a row of an earlier one."""
    words = [(t or "").lower().split() for t in texts]
    seen, out = set(), {}
    for i, w in enumerate(words):
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        out[i] = {k for j, run in enumerate(runs) if run in seen for k in range(j, j + 50)}
        seen.update(runs)
    return out


def repeated_lines():
    r = random.Random(23)
    common, lines = [prose(70, r) for _ in range(4)], [prose(7, r) for _ in range(5)]
    texts = []
    for i in range(120):
        parts = [prose(r.randrange(60), r), r.choice(common)[r.randrange(15) :], prose(r.randrange(20), r), r.choice(lines) * r.randrange(12)]
        if i % 3 == 0:
            parts.append(["the"] * r.randrange(150))
        if i % 4 == 0:
            r.shuffle(parts)
        texts.append(" ".join(w for p in parts for w in p))
    return [*texts, None, "", "x " * 60, "x " * 200]


def covered(rows):
    out = {}
    for x in rows:
        out.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
    return out


def test_exact_repeats_equal_brute_force_whatever_the_partitions(spark, monkeypatch):
    texts = repeated_lines()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, parts = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, batch in ((1, 10000), (64, 10000), (7, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found.append(sorted(substring.repeated_passages(df.repartition(n)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2]
    got, want = covered(found[0]), brute_repeats(texts)
    assert all(want[i] <= got.get(i, set()) for i in want)
    # hot hashes in two steps: other partners, the same coverage
    monkeypatch.setattr(substring, "TRIED", 1)
    monkeypatch.setattr(substring, "HOT_LEAST", 5)
    monkeypatch.setattr(substring, "SALTS", 4)
    assert len(substring.hot_grams(substring.keyed(df)[0])) > 100
    hot = covered(substring.repeated_passages(df).collect())
    assert all(want[i] <= hot.get(i, set()) for i in want)


def among_pieces(size, cases, seed):
    """Texts of which each case's last repeats `size` words of one before, among texts that hold 49 of these words."""
    r = random.Random(seed)
    texts = []
    for _ in range(cases):
        passage = prose(size, r)
        pieces = [passage[i : i + 49] for i in range(size - 48)] * 2
        r.shuffle(pieces)
        at = r.randrange(len(pieces))
        own = [*pieces[:at], passage, *pieces[at:], passage]
        texts += [" ".join(prose(r.randrange(1, 30), r) + p + prose(r.randrange(1, 30), r)) for p in own]
    return texts


@pytest.mark.parametrize(("size", "cases"), [(50, 60), (51, 20), (120, 5)])
@pytest.mark.parametrize("hot", [False, True])
def test_exact_repeats_among_pieces(spark, monkeypatch, size, cases, hot):
    if hot:
        for name, value in (("TRIED", 1), ("HOT_LEAST", 3), ("SALTS", 4)):
            monkeypatch.setattr(substring, name, value)
    texts = among_pieces(size, cases, size)
    got = covered(substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    want = brute_repeats(texts)
    assert sum(map(len, want.values())) >= size * cases
    assert all(want[i] <= got.get(i, set()) for i in want)


def test_keys_are_exact():
    r = random.Random(24)
    texts = [" ".join(prose(r.randrange(5), r) + w + prose(r.randrange(5), r)) for w in [prose(60, r) for _ in range(30)] for _ in range(3)]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(50, 90))) for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"ord": pa.array(range(len(texts)), pa.int64()), "key": pa.array([0] * len(texts), pa.int64()), "text": texts})
    gram, ord_, key, pos, edge = (np.concatenate(c) for c in zip(*substring._grams(batch), strict=True))
    h, _, place = substring.long_keys(gram, ord_, key, pos, edge)
    words = [t.split() for t in texts]
    runs = [tuple(words[o][p : p + 50]) for o, p in zip(place[0].tolist(), place[2].tolist(), strict=True)]
    assert sorted(zip(place[0].tolist(), place[2].tolist(), strict=True)) == [(i, j) for i, w in enumerate(words) for j in range(len(w) - 49)]
    assert len(set(runs)) == len(set(h.tolist())) == len(set(zip(runs, h.tolist(), strict=True)))


def test_exact_repeat_beside_words_that_match_in_part():
    exact, tail = [f"e{i}" for i in range(50)], [f"t{i}" for i in range(160)]
    a = np.array([hash(w) for w in exact + tail], np.int64)
    b = a.copy()
    b[50 + 3 :: 4] = 0  # three of four match: all words together match too little
    found = substring.align(a, b, np.array([0, 45]), np.array([0, 45]))
    assert found and found[0][0] == 0 and found[0][1] >= 50 and all(f[4] >= 0.8 for f in found)


def test_equal_ids_and_clashing_columns(spark):
    passage = " ".join(prose(80))
    rows = [(1, passage, "a", 1, "r"), (1, "other " + passage, "b", 2, "s"), (None, passage, "c", 3, "t"), (None, passage + " z", "d", 4, "u"), ((1 << 63) - 1, "big " + passage, "e", 5, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ord string, key long, spans string").withColumns({"row": F.lit(1), "cut": F.lit(2), "part": F.lit(3)})
    out = {r.spans: r for r in substring.cut_passages(df).collect()}
    assert len(out) == 5 and all((r.row, r.cut, r.part) == (1, 2, 3) for r in out.values())
    assert sum(r.text == t for (_, t, *_, name) in rows for r in [out[name]]) == 1
    assert all(len((r.text or "").split()) <= 2 or r.text in {t for _, t, *_ in rows} for r in out.values())
    ids = {r.doc_id for r in substring.repeated_passages(df).collect()}
    assert None in ids and (1 << 63) - 1 in ids


def test_unlike_texts_under_one_boilerplate(spark):
    """Buckets that boilerplate fills: their heads resemble hardly anyone, and copies among the rest are found all the same."""
    r = random.Random(31)
    boiler = prose(90, r)
    texts = []
    for _ in range(16):
        own = prose(25, r)
        texts += [" ".join(boiler + own), " ".join(boiler + edited(own, 2, r)), " ".join(edited(boiler, 12, r) + own)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert got == want and 1 < len(set(want.values())) < len(texts)


def test_hot_keys_are_dealt(spark, monkeypatch):
    from tarn.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(shared, "HOT_SALTS", 3)
    texts = fixture_texts() + ["equal text of some words here"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()} == brute_classes(texts)


@pytest.mark.parametrize("begin", [-9, -3, 0, 4, 30])
def test_diagonals_beyond_a_text_match_nothing(begin):
    a, b = np.array([0, 1, 2, 0], np.uint64), np.arange(8, dtype=np.uint64)
    same = substring._lanes(b, begin, len(a), 6, a) == a
    want = [[0 <= begin + r + i < len(b) and b[begin + r + i] == a[i] for i in range(len(a))] for r in range(6)]
    assert same.tolist() == want

def fuzzy_among_pieces(cases, seed, more=2):
    """Texts of which each case's last repeats 60 words of another but for 8 of them, each of its shingles in others before and between too."""
    r = random.Random(seed)
    texts, pairs = [], []
    for c in range(cases):
        passage = prose(60, r)
        other = list(passage)
        for i in r.sample(range(1, 59), 8):
            other[i] = f"changed{c}x{i}"
        pieces = [other[i : i + 20] for i in (0, 14, 28, 40)] * more
        own = [*pieces, passage, *pieces, other]
        pairs.append((len(texts) + len(own) - 1, len(texts) + len(pieces)))
        texts += [" ".join(prose(40, r) + p + prose(40, r)) for p in own]
    return texts, pairs


@pytest.mark.parametrize("hot", [False, True])
def test_fuzzy_passages_among_pieces(spark, monkeypatch, hot):
    if hot:
        for name, value in (("TRIED", 1), ("HOT_LEAST", 3), ("SALTS", 4)):
            monkeypatch.setattr(substring, name, value)
    texts, pairs = fuzzy_among_pieces(40, 41)
    rows = substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(x.doc_id, x.of_doc_id) for x in rows}
    assert sum(p in got for p in pairs) >= 38
    assert all(x.similarity >= 0.8 and x.end_word - x.start_word >= 50 for x in rows)


def test_contexts_of_a_passage_are_alike():
    r = random.Random(42)
    n = substring.BESIDE * 2 + substring.K
    rows = []
    for _ in range(300):
        a = [r.randrange(1, 40) for _ in range(n)]
        b = [r.randrange(1, 40) for _ in range(n)]
        at = r.randrange(5, 51)
        b[at : at + 50] = a[at : at + 50]
        for i in r.sample([i for i in range(at, at + 50) if not 50 <= i < 55], 10):
            b[i] = 99
        rows += [a, b]
    around = np.array(rows, np.uint16).view(substring.AROUND).ravel()
    ord_ = np.arange(len(rows), dtype=np.int64)
    for size in (len(rows), 50):  # by signatures, and each pair
        for block in (None, ord_[:size] % 2 == 1, ord_[:size] % 3 == 1):
            i, j = substring.alike(around[:size], ord_[:size], np.zeros_like(ord_[:size]), ord_[:size] % 2 == 1, block)
            got = set(zip(i.tolist(), j.tolist(), strict=True))
            assert all((k + 1, k) in got for k in range(0, size, 2) if block is None or block[k] != block[k + 1])
            assert all(y < x and x % 2 and (block is None or block[x] != block[y]) for x, y in got)


def test_contexts_that_go_on_only_by_words_of_two_passages():
    r = random.Random(43)
    n, K = substring.BESIDE * 2 + substring.K, substring.K
    passage = [r.randrange(1, 120) for _ in range(60)]
    # the passage ends three words behind the seed; those that follow differ, or go on for two words
    text = lambda tail: (passage[-(substring.BESIDE + K + 3) :] + tail + [r.randrange(120, 250) for _ in range(n)])[:n]
    rows = [text([]), text([251, 252]), text([253]), text([251, 252])]
    around = np.array(rows, np.uint8).view(substring.NARROW).ravel()
    ord_ = np.arange(4, dtype=np.int64)
    behind = np.full(4, 4, np.uint8)  # the fourth word behind the seed is open
    for sides, want in ((behind, {(3, 1)}), (np.full(4, substring.INSIDE), {(i, j) for i in range(4) for j in range(i)})):
        i, j, new = substring.alike(around, ord_, np.zeros_like(ord_), sides > 0, None, sides)
        assert set(zip(i[new].tolist(), j[new].tolist(), strict=True)) == want
        (grouped,) = substring.alike_in_groups(np.array([0]), np.array([4]), around, ord_, np.zeros_like(ord_), sides)
        assert set(zip(*(c[grouped[2]].tolist() for c in grouped[:2]), strict=True)) == want


def test_contexts_of_a_common_line_are_not_compared_by_pairs(monkeypatch):
    r = random.Random(44)
    n, cases = substring.BESIDE * 2 + substring.K, 100
    line = [r.randrange(1, 250) for _ in range(13)]
    rows, pairs = [], []
    for c in range(2000):
        row = [r.randrange(1, 250) for _ in range(n)]
        if c >= 2000 - cases:  # repeats 60 words of an earlier one but for 8
            pairs.append((c, c - 1000))
            row[20:80] = rows[c - 1000][20:80]
            for i in (24, 29, 34, 40, 45, 63, 68, 74):
                row[i] = 255
        row[47:60] = line
        rows.append(row)
    around = np.array(rows, np.uint8).view(substring.NARROW).ravel()
    ord_ = np.arange(len(rows), dtype=np.int64)
    looked, sure = [0], substring._sure
    monkeypatch.setattr(substring, "_sure", lambda a, s, i, j: looked.append(len(i)) or sure(a, s, i, j))
    sides = np.full(len(rows), substring.INSIDE)
    for block in (None, ord_ % 2000 < 1000):
        i, j, new = substring.alike(around, ord_, np.zeros_like(ord_), sides > 0, block, sides)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        assert got >= set(pairs) and new.all()
        assert all(y < x and (block is None or block[x] != block[y]) for x, y in got)
    assert sum(looked) < 2000  # of 2 million pairs, of which the signatures alone leave tens of thousands


def test_contexts_of_no_passage_long_enough_are_not_linked():
    r = random.Random(45)
    n, mid = substring.BESIDE * 2 + substring.K, substring.BESIDE
    other = lambda low: [r.randrange(low, low + 60) for _ in range(n)]
    cases = []
    for size, want in ((30, False), (42, False), (50, True), (70, True)):
        for at in (mid - 20, mid, mid + substring.K - size):  # equal words, and unlike ones on either side
            a, b = other(1), other(70)
            a[max(at, 0) : at + size] = b[max(at, 0) : at + size] = [250 - i % 100 for i in range(max(at, 0), min(at + size, n))]
            cases.append((a, b, want))
    around = np.array([c for a, b, _ in cases for c in (b, a)], np.uint8).view(substring.NARROW).ravel()
    there = np.arange(0, 2 * len(cases), 2)
    assert substring._reaches(around, there + 1, there)[0].tolist() == [want for *_, want in cases]


def test_best_links_first_and_others_for_open_words_only():
    late, early = np.array([9, 9, 9, 9, 9, 7]), np.array([1, 2, 3, 4, 5, 1])
    before, behind = np.array([0, 3, 9, 9, 1, 0], np.uint8), np.array([8, 9, 0, 1, 2, 0], np.uint8)
    assert substring._best(late, early, before, behind).tolist() == [True, True, True, True, False, True]
    # seeds of two documents at words 10 and 30 with five words before and twenty behind at most
    rest = [np.array(c, k) for c, k in zip(([5, 5, 6], [0, 0, 0], [10, 30, 10], [1, 1, 1], [0, 0, 0], [2, 2, 2], [5, 5, 5], [20, 20, 20]), substring.TYPES[substring.REST], strict=True)]
    span = lambda *rows: [np.array(c, k) for c, k in zip(zip(*rows, strict=True), substring.TYPES[substring.SPAN], strict=True)]
    assert substring.still_open(rest, span((5, 0, 0, 40, 1), (5, 0, 5, 35, 2))).tolist() == [False, True, True]
    assert substring.still_open(rest, span((5, 0, 0, 40, 1), (5, 0, 6, 35, 2))).tolist() == [True, True, True]
    assert substring.still_open(rest, span((5, 0, 0, 60, 1), (5, 0, 0, 60, 1))).tolist() == [True, True, True]  # one passage twice


def test_straight_chains_align_as_one_by_one():
    r = random.Random(44)
    texts, chains = [], []
    for c in range(200):
        a = [r.randrange(1, 500) for _ in range(r.randrange(20, 260))]
        b = [r.randrange(1, 500) for _ in range(r.randrange(9))] + [x if r.random() < 0.85 else 0 for x in a]
        d, x = len(b) - len(a), r.randrange(len(a) - 10)
        b[x + d : x + d + 5] = a[x : x + 5]
        if c % 3 == 0:  # words that only one of them has
            b[x + d + 7 : x + d + 7] = [501] * r.randrange(1, 6)
        texts.append((np.array(a, np.uint32), np.array([y or 600 for y in b], np.uint32)))
        chains.append((x, d))
    n, nb = (np.array([len(t[i]) for t in texts]) for i in (0, 1))
    x, d = (np.array(c) for c in zip(*chains, strict=True))
    turns, found = substring.straight(*(np.concatenate(t) for t in zip(*texts, strict=True)), np.cumsum(n) - n, n, np.cumsum(nb) - nb, nb, x, x, d)
    assert 0 < turns.sum() < 200
    for c, (a, b) in enumerate(texts):
        want = substring.align(a.astype(np.int64), b.astype(np.int64), x[c : c + 1], x[c : c + 1] + d[c])
        if not turns[c]:
            assert want == (substring._stretches(found[c], np.arange(n[c]) + d[c]) if c in found else [])


def test_cut_leaves_no_shuffle_files(spark):
    from tarn.llm.shared import CLEANUP, cut

    files = lambda: sum("shuffle_" in str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    setting, before = spark.conf.get(CLEANUP, None), files()
    done = cut(spark.range(10000).repartition(5, "id"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and done.count() == 10000 and spark.conf.get(CLEANUP, None) == setting
