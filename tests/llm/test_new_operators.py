"""URL filters, conversation repair and periodic runs against brute force."""

import functools
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import periodic, turn_repair, url_filter
from tarn.llm.queries import ORACLE_SQL, QUERIES, with_periods

SF = "/root/testdata/sf0.001"
R = random.Random(3)


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_turn_repair"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert len(want) and rows(got) == rows(want)


# urls

URLS = [
    None, "", "no scheme", "://", "http://", "http://A.Example.COM", "http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "http://notexample.com/en/", "x://y://z/", "http://example.com?x=/en/", "http://example.com#/en/",
    "http://example.com/", "http://é.net/es/ñ", "http://net/fr/", "http://.net/fr/", "http://a.net/fr", "http://com./", "http://" + "a." * 3000 + "com/" + "x" * 50_000, "same://example.org/", "same://example.org/", "http://Ünet.NET/es/\n?",
]


def judged_by_hand(url, rules):
    _, there, rest = (url or "").partition("://")
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups() if there else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string")


@pytest.mark.parametrize("digest", [url_filter.digest, functools.partial(lambda n, k: xxhash.xxh64_intdigest(k) % n, 3)], ids=["xxh64", "colliding"])
def test_urls_equal_brute_force(spark, digest):
    labels = ["a", "b", "net", "com", "example", "www"]
    rules = {(".".join(R.choices(labels, k=R.randrange(1, 4))), R.choice(["", "/", "/e", "/en/", "/en/b", "en"])): R.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = URLS + ["http://" + ".".join(R.choices(labels, k=R.randrange(1, 5))) + R.choice(["", "/", "/en/b/c", "/e?x", "#/en/"]) for _ in range(500)]
    built = url_filter.build_rules(spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block"), (rules[0][0].upper(), rules[0][1], "allow")], "host string, path string, verdict string"), part=50, digest=digest)
    assert built.parts > 1
    for r in url_filter.judge(pages(spark, urls), built).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged_by_hand(urls[r.page_id], rules)


def test_urls_of_empty_tables(spark):
    none = url_filter.build_rules(spark.createDataFrame([], "host string, path string, verdict string"))
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages(spark, URLS), none).collect()} == {(None, "allow")}
    assert url_filter.judge(pages(spark, []), none).count() == 0
    both = url_filter.build_rules(spark.createDataFrame([("a", None, "allow"), ("a", "", "block")], "host string, path string, verdict string"))
    assert url_filter.judge(pages(spark, ["x://a"]), both, "none").first().verdict == "block"


# conversations


def repaired_by_hand(rows):
    """All edit strings of a short conversation, or the cheapest by a search over states."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best = {(0, ""): (0, "", ())}
    queue = [(0, "", 0, "", ())]
    done, answer = set(), None
    import heapq

    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            answer = (cost, audit, out)
            break
        go = []
        for who in "ua":
            if (state, who) in nexts:
                go.append((cost + 3, audit + "I", i, nexts[state, who], out + (names[who] + ":",)))
        if i < len(rows):
            _, role, text = rows[i]
            go.append((cost + 4, audit + "D", i + 1, state, out))
            if kinds[i] in ("", "truncated"):
                more = 3 if kinds[i] else 0
                if (state, role[:1]) in nexts:
                    go.append((cost + more, audit + "K", i + 1, nexts[state, role[:1]], out + (f"{role}:{text}",)))
                for who in "ua":
                    if (state, who) in nexts:
                        go.append((cost + more + 3, audit + "R", i + 1, nexts[state, who], out + (f"{names[who]}:{text}",)))
        for g in go:
            heapq.heappush(queue, g)
    cost, audit, out = answer
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations():
    out = {}
    for c in range(60):
        n = R.choice([0, 1, 2, 3, 5, 9, 14]) if c % 10 else 40
        out[c] = [(R.choice([None, *range(10)]), R.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "u"]), R.choice(["Hi.", "no end", "", " \t", "What?", "é!", "x" * R.randrange(9) + "."])) for _ in range(n)]
    out[60] = [(i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(30)]
    out[61] = [(1, "user", "same.")] * 40
    out[62] = [(i % 7, R.choice(["user", "assistant"]), "same.") for i in range(50)] + [(9, "assistant", "y" * 100_000)]
    out[None] = [(None, "user", "Null."), (None, "system", "Null.")]
    return out


@pytest.mark.parametrize("long", [512, 8])
def test_repair_equals_search(spark, long, monkeypatch):
    if long == 8:
        monkeypatch.setattr(turn_repair, "SEGMENT_BITS", 2)  # several segments and levels
    every = conversations()
    rows = [(c, t, r, x, False) for c, turns in every.items() for t, r, x in turns] + [(c, 5, "", "", True) for c in every]
    R.shuffle(rows)
    got = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean").repartition(3), long).collect()
    assert len(got) == len(every)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == repaired_by_hand(every[r.conv_id]), r.conv_id


def test_search_equals_every_edit_string():
    """The brute force itself, by all edit strings of tiny conversations."""
    grammar = re.compile(r"(s?(ua)+)?")
    for _ in range(60):
        rows = [(i, R.choice(["user", "assistant", "system", "x"]), R.choice(["a.", "b", "", "a."])) for i in range(R.randrange(4))]
        found = []
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            for edits in itertools.product("KDua", repeat=len(rows)):
                cost, audit, said, seen, ok = 3 * len("".join(inserts)), "", "", set(), True
                for k, (e, (_, role, text)) in enumerate(zip(edits, rows, strict=True)):
                    audit += "I" * len(inserts[k]) + ("R" if e in "ua" else e)
                    said += inserts[k] + {"K": role[:1], "D": ""}.get(e, e)
                    must = not text or (role, text) in seen
                    seen.add((role, text))
                    ok &= e == "D" or not must
                    cost += 4 if e == "D" else (0 if e == "K" else 3) + (0 if text.endswith(".") else 3)
                if ok and grammar.fullmatch(said + inserts[-1]):
                    found.append((cost, audit + "I" * len(inserts[-1])))
        assert min(found) == repaired_by_hand(rows)[5:7]


def test_damage(spark):
    rows = [(c, t, "system", "A. b! c?") for c in (None, 1, 2, 3) for t in (None, *range(30))] + [(4, 4, None, None)]
    got = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if harm == 4 else role, "" if harm == 1 else text.translate({ord(x): None for x in ".!?"}) if harm == 2 else text, False)
        want += [(c, t, "", "", True)] if harm == 0 else [row] * (2 if harm == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert turn_repair.repair(turn_repair.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# periodic runs


def runs_by_hand(words):
    n, found = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q) and not any((i, length, p) in found for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def described(words):
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    if not runs:
        return (0, None, None, None, None, *tail)
    from fractions import Fraction

    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (len(runs), s, n, q, 1000 * n // q, *tail)


def texts():
    yield from [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a b " * 12, "a\x1cb " * 30, "é\u00a0x " * 25 + "y", "A a " * 30]
    for _ in range(60):
        base = [R.choice("abc") for _ in range(R.randrange(1, 40))]
        yield " ".join(R.choices("abcdef", k=R.randrange(30)) + base * R.randrange(1, 9) + base[: R.randrange(len(base))] + R.choices("abc", k=R.randrange(50)) + base * 3)
    for _ in range(10):
        yield " ".join(R.choices("ab", k=600))
        yield " ".join(str(i) for i in range(400)) + "\n" + " ".join(str(i) for i in range(350)) + " " + " ".join(str(i) for i in range(350))
    a, b = "a", "a b"  # Fibonacci and Thue-Morse words are full of squares
    for _ in range(13):
        a, b = b, f"{b} {a}"
    yield b
    yield " ".join("01"[bin(i).count("1") % 2] for i in range(1024)) + " 1 0" * 40
    yield "w " * 5000 + " ".join(map(str, range(9000))) + (" p q r" * 2000)


def test_runs_equal_brute_force(spark):
    every = list(texts())
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(every)], "doc_id long, text string, period string, start int").repartition(3)
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(every)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", every[r.doc_id] or "")
        if len(words) < 12_000:
            assert tuple(r)[1:] == described(words), r.doc_id
        else:
            assert (r.n_runs, r.start, r.length, r.period) == (2, 0, 5000, 1)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_blocks_and_steps_do_not_matter(spark, monkeypatch):
    every = [t for t in texts()][:50]
    whole = periodic._block(every)
    monkeypatch.setattr(periodic, "STEP", 7)
    assert [periodic._block([t])[0] for t in every] == whole


def test_planted_periods(spark):
    every = [(i, " ".join(str(j) for j in range(R.randrange(0, 120)))) for i in range(300)] + [(None, "a b c d e f g"), (7, None), (300, " x\ty ")]
    got = with_periods(spark.createDataFrame(every, "doc_id long, text string")).collect()
    want = []
    for doc_id, text in every:
        h, words = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), (text or "").split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        want.append((doc_id, text))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    for r in with_periods(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(words) < 3000:
            assert rows[r.doc_id] == described(words)
