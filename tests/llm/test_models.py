"""Toxicity and quality by held-out rows, gradients and edge cases; the pipeline stage by stage."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tarn.llm import minhash, quality, substring, toxicity
from tarn.llm.queries import QUERIES
from tarn.llm.words import ALNUM, words

SF = "/root/testdata/sf0.01"
R = random.Random(2)
BAD = ["idiot", "moron", "scum"]
WORDS = ["".join(R.choice("aeioulnrst") for _ in range(R.randrange(2, 7))) for _ in range(400)]


def text(n, bad):
    out = [R.choice(WORDS) for _ in range(n)]
    for _ in range(bad):
        out[R.randrange(n)] = R.choice(BAD)
    return " ".join(out)


def test_gradients():
    p = toxicity.fit([["a b c"], ["d e"]], np.array([0, 1]), epochs=0)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    w = words(pa.array(["alpha beta gamma alpha", "delta eps"], pa.string()), ALNUM)
    word, gram, of, word_of = toxicity.vocabulary(w)
    _, begin, size = toxicity.windows(w)

    def loss(p):
        x = toxicity.inputs(p, word, gram, of)
        return float((toxicity.logits(p, x, toxicity._index(w, word_of, len(x), begin, size)) * [1.0, -2.0]).sum())

    x, state = toxicity.inputs(p, word, gram, of), {}
    toxicity.logits(p, x, toxicity._index(w, word_of, len(x), begin, size), state)
    g = toxicity._gradients(p, x, toxicity._index(w, word_of, len(x), begin, size), state, np.array([1.0, -2.0], np.float32), word, gram, of)
    r = np.random.default_rng(0)
    for k in ("in", "ahead", "back", "attend", "attend_out", "out", "out_bias", "in_bias", "word", "char"):
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in p[k].shape)
            if k == "word":
                at = (int(word[0]), at[1])
            if k == "char":
                at = (int(gram[0]), at[1])
            old, e = p[k][at], 1e-2
            p[k][at] = old + e
            up = loss(p)
            p[k][at] = old - e
            down = loss(p)
            p[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-2 * max(1.0, abs(g[k][at])), k


def test_windows_cover_whole_texts():
    for n in (1, 31, 32, 33, 56, 57, 500):
        w = words(pa.array([" ".join(["x"] * n)], pa.string()), ALNUM)
        _, begin, size = toxicity.windows(w)
        assert set().union(*(range(b, b + s) for b, s in zip(begin, size))) == set(range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text(R.randrange(20, 200), 4 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out(spark, labelled):
    held = toxicity.held_out(labelled.doc_id)
    model = toxicity.train(labelled, labelled.filter(~held))
    got = toxicity.score_texts(labelled.filter(held), model).collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in got]) > 0.95
    late = spark.createDataFrame([(1, text(3000, 0) + " " + text(40, 12)), (2, None), (3, ""), (4, " .!? ")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_texts(late, model).collect()}
    assert scores[1] > 0.5 and [scores[i] for i in (2, 3, 4)] == [0, 0, 0]


def test_one_class_only(spark, labelled):
    none = labelled.filter("toxic = 0")
    assert {r.score for r in toxicity.score_texts(labelled, toxicity.train(labelled, none)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_texts(labelled, toxicity.train(labelled, labelled.filter("toxic = 1"))).collect()} == {1.0}
    assert toxicity.train(labelled, labelled.limit(0)) == 0.0
    assert toxicity.score_texts(labelled.limit(0), 1.0).count() == 0


def test_grades_in_order(spark):
    rows = [(i, " ".join([R.choice(WORDS)] * 2 + [R.choice(WORDS).upper() + "!!" if R.random() < (2 - i % 3) * 0.4 else R.choice(WORDS) for _ in range(80)]), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df, df.filter("doc_id < 600"))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = quality.rate(df.filter("doc_id >= 600"), model, wanted=1).collect()
    assert np.mean([round(r.expected_grade) == r.quality for r in got]) > 0.85
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 and r.keep == (r.tail_prob >= 0.5) for r in got)
    edge = quality.rate(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert edge[0].tail_prob == edge[1].tail_prob
    single = quality.rate(df, quality.train(df, df.filter("quality = 2")))
    assert {r.expected_grade for r in single.collect()} == {2.0}
    assert quality.rate(df, quality.train(df, df.limit(0))).filter("expected_grade != 0").count() == 0


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 4 != 0"))
    got = quality.rate(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in got]) > 0.9


def test_pipeline_stages(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "encoding"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != "encoding":
            assert docs.columns == before.columns
        seen[name] = docs.collect()
    everything = {r.doc_id: r for r in before.collect()}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert np.mean([(i in kept) == (t == 0) for i, t in labels.items()]) > 0.95
    one = sorted(r.doc_id for r in seen["near_dedup"])
    first = spark.createDataFrame([(i, everything[i].text) for i in kept], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(first).collect()}
    assert one == sorted(set(classes.values()))
    assert sorted(r.doc_id for r in seen["substring_dedup"]) == one
    second = spark.createDataFrame([(r.doc_id, r.text) for r in seen["near_dedup"]], "doc_id long, text string")
    repeats = {r.doc_id for r in substring.repeated_passages(second).collect()}
    for r in seen["substring_dedup"]:
        assert (r.text != everything[r.doc_id].text) == (r.doc_id in repeats)
        assert r.n_chars == (len(r.text) if r.doc_id in repeats else everything[r.doc_id].n_chars)
    times = {}
    for r in seen["mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(one) and max(times.values()) <= 2
    assert sorted(r.doc_id for r in seen["encoding"]) == sorted(r.doc_id for r in seen["mixing"])
    assert all(r.n_tokens == len(r.ids) for r in seen["encoding"])


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """Null, empty, repeated and very long rows, names that operators use themselves, and tables without rows."""
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    own = text(60, 0)
    long = " ".join(f"{w}{i}" for i in range(40) for w in WORDS)
    rows = [(1, own), (1, own), (2, own), (None, own), (3, None), (3, None), (4, ""), (5, "  "), (6, long), (7, text(40, 0) + " " + long), (None, None)]
    names = ["__toxicity", "__key", "__of", "__node", "__stays", "__cut0", "__copy", "ids", "score", "row", "a.b"]
    made = [(i, t, "s" if k % 2 else None, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(made, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(tmp_path))
        if name != "encoding":
            assert done.schema.names == docs.schema.names
        docs = spark.createDataFrame(kept.setdefault(name, done.collect()), done.schema)
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []
    assert sorted(r["a.b"] for r in kept["toxicity"]) == sorted(f"a.b{k}" for k in range(len(rows)))
    assert sorted((r.doc_id for r in kept["near_dedup"] if (r.text or "").strip())) == [1, 6]  # 7 is 6 with a few words more
    assert sum(not (r.text or "").strip() for r in kept["near_dedup"]) == 5
    assert len(kept["substring_dedup"]) == len(kept["near_dedup"])
    assert {r.doc_id for r in kept["mixing"]} <= {1, 6}
    assert len(kept["encoding"]) == len(kept["mixing"])


def test_quality_of_repeated_rows_and_clashing_names(spark):
    good, bad = (" ".join(w for w in WORDS[k::2][:30]) for k in (0, 1))
    rows = [(i, good if i % 2 else bad, "x", "y") for i in range(20)] * 3 + [(50, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string, `__score` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=10)
    assert np.array_equal(model.weights, quality.train(docs.repartition(7), labels, sample=10).weights)
    got = quality.rate(docs, model).collect()
    assert len(got) == len(rows) and all(r.keep == (r.doc_id % 2 == 1) and r["__score"] == "y" for r in got if r.doc_id < 50)
    assert quality.rate(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("name", ["op3_toxicity", "op5_bpe", "op6_media", "op8_quality", "op9_token_counts"])
def test_queries_have_a_row_for_each_document(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
