"""Encoding, token counts, media, chat formatting and mixing against brute force and round trips."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarn.llm import bpe, chat_format, media, mixing, token_counts
from tarn.llm.shared import files_at
from tarn.llm.queries import QUERIES

tok = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
R = random.Random(1)
HARD = [
    None, "", " ", "  ", "a ", " a", "\t\n", "▁", "a▁▁b ▁", "aaaaaaaaaaaaa", "a" * 5001, "  \n\n x  ", "日本語テキスト" * 300, "<|endoftext|> <s> </s>", "\x00\x7fÿ", "ab" * 3000 + "é" * 999, "😀👍🏽 don't 123456", "same", "same",
    *("".join(R.choice("abcde,  éß") for _ in range(300)) for _ in range(20)), *("".join(R.choice("ab") for _ in range(2000)) for _ in range(3)),
]


def table(spark, texts, ids=None):
    rows = [((i if ids is None else ids[i]), t, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_bpe_equals_library(spark):
    import tiktoken

    path = tok.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = bpe.decode(bpe.encode(table(spark, HARD), path, tok.PATTERN), path)
    for r in done.collect():
        assert r.ids == own.encode_ordinary(HARD[r.doc_id] or "")
        assert bytes(r.decoded) == (HARD[r.doc_id] or "").encode()
    once = bpe.round_trip(table(spark, HARD).drop("ids"), path, tok.PATTERN)
    assert sorted(map(str, once.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, done.select("doc_id", "ids", "decoded").collect()))
    assert bpe.encode(table(spark, []), path, tok.PATTERN).count() == 0


def test_bitmap_queue_orders_ranks():
    q = bpe.BitmapQueue(300_000)
    ranks = [R.randrange(300_000) for _ in range(2000)]
    for r in ranks:
        q.push(r, r)
    out = []
    while got := q.pop():
        out += got[1]
        if len(out) % 7 == 0:
            q.push(5, 5)
            ranks.append(5)
    assert sorted(out) == sorted(ranks)


def test_token_counts_equal_library(spark):
    import sentencepiece

    path = tok.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.count_tokens(table(spark, HARD), path, 100).collect():
        n = len(sp.encode(HARD[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((HARD[r.doc_id] or "").encode()), n, n > 100)


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.media_columns(table(spark, HARD)).collect()}
    assert len(rows) == len(HARD)
    for i, t in enumerate(HARD):
        p, r = media.payload(t), rows[i]
        assert len(p) % 192 == 0 and len(p) >= 192 and p.rstrip(b" ") == (t or "").encode().rstrip(b" ")
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() == r.digest
        assert r.tail_crc32 == zlib.crc32(p[-16:])
        png = media.to_png(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), hashlib.sha256(png).hexdigest(), media.feature(p))
        assert r.width * r.height == len(p)
    assert rows[17].digest == rows[18].digest and rows[17].feature == rows[18].feature
    assert media.media_columns(table(spark, [])).count() == 0


def test_feature_follows_every_sample():
    plain = b" " * 192 * 64
    for row in range(64):
        other = bytearray(plain)
        other[192 * row : 192 * row + 24] = b"z" * 24
        assert media.feature(bytes(other)).split("hash=")[1] != media.feature(plain).split("hash=")[1]
    assert media.feature(plain[:192]).split("hash=")[1] == "0" * 16


def test_folders_by_the_names_of_cluster_connectors(tmp_path):
    for scheme in ("s3a", "s3n", "s3"):
        files, path = files_at(f"{scheme}://key:secret@bucket/folder?region=us-east-1&endpoint_override=localhost")
        assert files.type_name == "s3" and path == "bucket/folder"
    assert files_at(f"file://{tmp_path}")[1] == str(tmp_path)


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(table(spark, []), tok.path("piece_bpe_32k.model")).count() == 0


def test_shards_are_tar_files(spark, tmp_path):
    import tarfile

    index, folder = media.write_media(table(spark, ["a", "b", "a"]), f"file://{tmp_path}/m")
    found = {}
    for p in (tmp_path / "m").iterdir():
        with tarfile.open(p) as t:
            for e in t:
                found[e.name] = t.extractfile(e).read()
    for r in index.collect():
        assert media.from_png(found[f"{r.digest}.png"]) == media.payload("ab"[r.doc_id % 2])
    heads = media.read_headers(index, folder).collect()
    assert {h.digest for h in heads} == {r.digest for r in index.collect()} and all((h.width, h.height) == (192, 1) for h in heads)


def numbered(df):
    messages, skeleton = chat_format.conversations_as_trees(df)
    return {"messages": messages, "skeleton": skeleton}


CHAT = "tree string, node string, parent string, role string, text string, score double, path string"


def test_branches_are_ranked(spark):
    rows = [("t", "a", None, "user", "q", 1.0, ""), ("t", "b", "a", "assistant", "low", 0.1, ""), ("t", "c", "a", "assistant", "high", 0.9, ""), ("t", "d", "c", "user", "more", 0.5, ""), ("t", "e", "c", "user", "tie", 0.5, ""), ("u", "x", "gone", None, None, None, ""), ("v", "p", "q", "user", "cycle", 1.0, ""), ("v", "q", "p", "user", "cycle", 1.0, ""), ("v", "r", "q", "user", "under it", 1.0, "")]
    got = sorted((r.tree, r.leaf, r["rank"], r.n_turns) for r in chat_format.format_trees(spark.createDataFrame(rows + rows[:1], CHAT), None).collect())
    assert got == [("t", "b", 3, 2), ("t", "d", 1, 3), ("t", "e", 2, 3), ("u", "x", 1, 1)]
    best = chat_format.format_trees(spark.createDataFrame(rows, CHAT)).filter("tree = 't'").first()
    assert best.formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nhigh<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [best.formatted[s.start : s.end] for s in best.loss_spans] == ["high"]
    assert chat_format.format_trees(spark.createDataFrame([], CHAT)).count() == 0


def test_ids_of_different_trees_and_repeated_ids(spark):
    rows = [(t, i, p, "user", f"{t}{i}", None, "") for t in ("t1", "t2", None) for i, p in (("1", None), ("2", "1"))]
    rows += [("t1", "2", "1", "user", "a later repeat", 5.0, ""), ("t1", "2", "1", "assistant", "the least", 5.0, ""), ("t2", None, None, "user", "no id", 9.0, "")]
    got = sorted((str(r.tree), str(r.leaf), r.n_turns, r.formatted.count("the least")) for r in chat_format.format_trees(spark.createDataFrame(rows, CHAT), None).collect())
    assert got == [("None", "2", 2, 0), ("t1", "2", 2, 1), ("t2", "2", 2, 0), ("t2", "None", 1, 0)]


def test_messages_without_an_id_are_all_kept(spark):
    rows = [("t", "1", None, "user", "q", 1.0, "")] + [("t", None, "1", "assistant", f"a{i}", 0.1 * i, "") for i in range(3)] + [("t", None, "1", "assistant", "a2", 0.2, "")]
    got = chat_format.format_trees(spark.createDataFrame(rows, CHAT), None).collect()
    said = [r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "") for r in sorted(got, key=lambda r: r["rank"])]
    assert said == ["user\nq\nassistant\na2\n"] * 2 + ["user\nq\nassistant\na1\n", "user\nq\nassistant\na0\n"] and {r.leaf for r in got} == {None}


def test_sql_of_roles_with_line_ends(spark, tmp_path):
    import duckdb

    from tarn.llm.queries import ORACLE_SQL

    rows = [(1, 0, "us\ner<|", "a\\b"), (1, 1, "assistant", None), (2, None, None, "<|x"), (2, 1, "\n", "t")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op1_chat_format"]).fetchall())
    assert sorted(map(tuple, QUERIES["op1_chat_format"](spark, str(tmp_path)).collect())) == want and len(want) == 3


def test_comb(spark):
    """A leaf at every message of a long chain: paths are ranked without being written out."""
    n = 10_000
    rows = [("t", str(i), str(i - 1) if i else None, "user", "s", 0.5, "") for i in range(n)] + [("t", f"x{i}", str(i), "assistant", "leaf", 0.9 if i == 4321 else 0.0, "") for i in range(n)]
    got = chat_format.format_trees(spark.createDataFrame(rows, CHAT)).collect()
    assert [(r.leaf, r.n_turns) for r in got] == [("x4321", 4323)]


def test_escapes_are_reversible(spark):
    parts = ["<|im_end|>\n", "<|im_start|>", "\\", "<", "|", "\n", "<|", "x", "<\\|", "ö"]
    texts = ["".join(R.choice(parts) for _ in range(R.randrange(12))) for _ in range(300)]
    rows = [(i // 3, i % 3, R.choice(["user", "assistant", "a\nb<|", None]), R.choice([t, t, None])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat_format.format_trees(**numbered(df))
    got = done.select("tree", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.learnt_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    assert len(got) == 100
    for r in got:
        own = [(b or "", c or "") for a, _, b, c in rows if a == r.tree]
        assert [tuple(x) for x in r.t] == own
        assert r.l == [c for b, c in own if b == "assistant"]


def test_long_chain(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat_format.format_trees(**numbered(df)).collect()}
    assert got[1].n_turns == 300 and got[None].n_turns == 1
    assert got[1].formatted == "".join(f"<|im_start|>{b}\n{c}<|im_end|>\n" for _, _, b, c in rows[:300])


def brute_targets(sizes, budget):
    """Fill by weight, hold at the caps, share the rest again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), budget
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
        left = budget - sum(out.values())
    return out


DOCS = "doc_id long, text string, source string, of string, size int"


@pytest.mark.parametrize("seed", range(3))
def test_mix_follows_targets(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(mixing, "FEW", 1)
    r = random.Random(seed)
    rows = [(r.choice([i, i, None]), r.choice([" ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 30))), None, "  "]) if i % 5 == 0 else "x y\tz " * r.randrange(1, 9), r.choice(["a", "a", "a", "b", "ü", None, "c"]), "k", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    mix = mixing.plan_mix(df)
    got = mixing.mixed_sizes(mix).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, 1.5 * sum(sizes.values()))
    assert sorted(round(t, 6) for t in {x.target for x in got}) == sorted({round(t, 6) for t in want.values()})
    taken = {}
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size)
        taken[x.source_size, x.target] = taken.get((x.source_size, x.target), 0) + x.taken
    for (_, t), n in taken.items():
        assert abs(n - t) <= 40
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(mixing.plan_mix(df.repartition(7))).collect()))
    out = mixing.mixed_documents(df, mix)
    assert out.columns == df.columns
    assert sum(len((x.text or "").split()) for x in out.collect()) == sum(taken.values())


def test_rows_that_repeat_do_not_exceed_the_budget(spark, monkeypatch):
    """600 rows equal in id and text: some of them are taken, one by one, as far as the target goes."""
    rows = [(-7, "w " * 15, "a", "k", 1)] * 600 + [(i, "x " * (i % 20 + 1), "b" if i % 2 else "c", "k", 1) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    sizes = sum(len(t.split()) for _, t, *_ in rows)
    mix = mixing.plan_mix(df)
    got = mixing.mixed_sizes(mix).collect()
    assert sum(x.taken for x in got) <= 1.5 * sizes
    for s in {x.source_size for x in got}:
        own = [x for x in got if x.source_size == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 40
    assert len({x.taken for x in got if x.doc_id == -7}) == 2  # equal rows are not all taken alike
    monkeypatch.setattr(mixing, "EDGE", 1)
    monkeypatch.setattr(mixing, "TICKS", 3)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(mixing.plan_mix(df)).collect()))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mixed_sizes(mixing.plan_mix(df)).count() == 0
    some = spark.createDataFrame([(1, None, None, "k", 1), (2, "  ", "a", "k", 1)], DOCS)
    assert [x.taken for x in mixing.mixed_sizes(mixing.plan_mix(some)).collect()] == [0, 0]


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_mixing"])
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    from tarn.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    row = lambda df: sorted(map(repr, df[cols].itertuples(index=False, name=None)))
    assert row(got) == row(want)
