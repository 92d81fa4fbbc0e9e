"""Repair of conversations whose turns lost their order of speakers.

A whole conversation's roles read ``(s?(ua)+)?`` by their initials: at most one system turn, then user and assistant in
turn. Turns may be kept, given another role, deleted, or inserted empty, each at a price; the cheapest edits win, of
equally cheap ones those whose initials come first in ASCII.

Conversations are hashed into partitions, and each partition goes through DuckDB in batches of whole conversations. One recursive
query repairs a batch: each recursion advances one turn for all its conversations at once and keeps, for every state of
the grammar, the least cost and with it the audit (the edits so far). Which role an edit gives follows from the edits before it, so
the audit of the last turn says everything, and the same batch writes the repaired turns from it.

A conversation of more than LONG rows (and more than one in `MOST_LONG` of all, so at most MOST_LONG of them) goes another way: its
slim rows (digests in place of texts) are put in order by ranges and cut into segments of 256 rows. The same recursion finds for each segment
the least cost and audit from every state to every state; then segments are advanced over in place of turns, level by level. Texts meet
their edits by digest, are joined a segment at a time, and only a running SHA-256 sees a whole conversation.

Defined results: null role and text are one space; turns are in order (nulls first), equal turns by role, then text (in long
conversations by its first 64 characters and a digest); rows that repeat are duplicates; very long texts are compared whole; a null conv_id is a
conversation of its own; conversations without rows have zeros, an empty audit and the digest of nothing; an empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Prices of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows beyond which a conversation is cut into segments, and how many such there may be.
LONG, MOST_LONG = 512, 10_000
#: Rows of a segment and segments of the next level's, as a power of two.
SEGMENT_BITS = 8
#: Rows and bytes of one DuckDB batch, unless one conversation has more.
BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20

SPACES = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
NAMES = {"u": "user", "a": "assistant"}
#: States of the grammar: nothing yet, after system, after user, after assistant; which initial leads where.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _speaker(state: int) -> str:
    """Who may be put in: never a system turn."""
    return "a" if state == USER else "u"


def _moves() -> list[tuple]:
    """(kind, initial, state, to, cost, said) of a turn that is whole (k), truncated (t) or must go (d).

    `said` is the audit with the role that an inserted or changed turn gets. One insertion before a turn is enough: a second
    leads back to what could be taken without it.
    """
    out = []
    for kind in "ktd":
        for initial in "sua?":
            for state in range(4):
                out.append((kind, initial, state, state, DELETE, "D"))
                before = [(state, 0, "")] + [(STEPS[state, _speaker(state)], INSERT, "I" + _speaker(state))]
                for at, paid, said in before if kind != "d" else []:
                    price = paid + (TRUNCATED if kind == "t" else 0)
                    if (at, initial) in STEPS:
                        out.append((kind, initial, state, STEPS[at, initial], price, said + "K"))
                    out.append((kind, initial, state, STEPS[at, _speaker(at)], price + REROLE, said + "R" + _speaker(at)))
    return out


def _ends() -> list[tuple[int, int, str]]:
    """(state, cost, said) of what is put in after the last turn."""
    out = []
    for state in range(4):
        at, cost, said = state, 0, ""
        while at not in (START, ASSISTANT):
            said += "I" + _speaker(at)
            at, cost = STEPS[at, _speaker(at)], cost + INSERT
        out.append((state, cost, said))
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
    con.execute(f"CREATE TABLE moves AS SELECT * FROM (VALUES {_values(_moves())}) AS m(kind, initial, state, \"to\", cost, said)")
    con.execute(f"CREATE TABLE ends AS SELECT * FROM (VALUES {_values(_ends())}) AS e(state, cost, said)")
    return con


#: One turn a recursion, for all conversations: from (g, i, start, state) and the turn's moves to the best of each state.
WALK = """
WITH RECURSIVE walk AS (
  SELECT g, CAST(0 AS BIGINT) AS i, start, start AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM begun
  UNION ALL
  SELECT g, i, start, state, best.cost, best.audit FROM (
    SELECT w.g, w.i + 1 AS i, w.start, m."to" AS state, min({'cost': w.cost + m.cost, 'audit': w.audit || m.said}) AS best
    FROM walk w JOIN turns t ON t.g = w.g AND t.i = w.i + 1 JOIN moves m ON m.state = w.state AND %s
    GROUP BY ALL))
"""
BY_KIND = "m.kind = t.kind AND m.initial = t.initial"
ILLEGAL = "lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au')"

#: The turns of whole conversations, in order, each with its first fault.
TURNS = f"""
CREATE OR REPLACE TEMP TABLE turns AS
WITH named AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, * FROM batch),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM named WHERE NOT gone),
judged AS (
  SELECT *, CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT ended THEN 'truncated' ELSE '' END AS fault
  FROM placed)
SELECT g, i, turn, role, text, fault, initial, CASE fault WHEN '' THEN 'k' WHEN 'truncated' THEN 't' ELSE 'd' END AS kind,
       CAST({ILLEGAL} AS INT) AS illegal
FROM judged"""

REPAIRED = f"""
{WALK % BY_KIND},
size AS (SELECT g, max(i) AS n FROM turns GROUP BY g),
best AS (
  SELECT w.g, min({{'cost': w.cost + e.cost, 'audit': w.audit || e.said}}) AS best
  FROM walk w JOIN size s ON s.g = w.g AND s.n = w.i JOIN ends e ON e.state = w.state GROUP BY w.g),
chosen AS (SELECT g, best.cost AS cost, best.audit AS audit, regexp_extract_all(best.audit, '(?:I[ua])*(?:K|R[ua]|D)') AS edits FROM best),
written AS (
  SELECT t.g, t.i, c.edits[t.i] AS edit, replace(replace(regexp_extract(edit, '^(?:I[ua])*'), 'Iu', chr(10) || 'user:'), 'Ia', chr(10) || 'assistant:')
         || CASE WHEN edit LIKE '%D' THEN '' WHEN edit LIKE '%Ru' THEN chr(10) || 'user:' || t.text WHEN edit LIKE '%Ra' THEN chr(10) || 'assistant:' || t.text
                 ELSE chr(10) || t.role || ':' || t.text END AS line
  FROM turns t JOIN chosen c ON c.g = t.g),
said AS (SELECT g, string_agg(line, '' ORDER BY i) AS lines FROM written GROUP BY g),
counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, coalesce(sum(illegal), 0) AS illegal
  FROM turns GROUP BY g),
convs AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id FROM (SELECT DISTINCT conv_id FROM batch))
SELECT v.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(n.blank, 0) AS BIGINT) AS blank, CAST(coalesce(n.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(n.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(n.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(c.cost, 0) AS BIGINT) AS cost,
       regexp_replace(coalesce(c.audit, ''), '[ua]', '', 'g') AS audit,
       sha256(substr(coalesce(s.lines, '') || replace(replace(regexp_extract(coalesce(c.audit, ''), '(?:I[ua])*$'), 'Iu', chr(10) || 'user:'), 'Ia', chr(10) || 'assistant:'), 2)) AS repaired_sha256
FROM convs v LEFT JOIN chosen c ON c.g = v.g LEFT JOIN said s ON s.g = v.g LEFT JOIN counted n ON n.g = v.g"""


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive rows with equal keys; the last group of a batch may go on in the next."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows or sum(t.nbytes for t in held) >= size:
            every = pa.concat_tables(held).combine_chunks()
            last, at = [every[k][every.num_rows - 1].as_py() for k in keys], every.num_rows - 1
            while at and all(every[k][at - 1].as_py() == v for k, v in zip(keys, last, strict=True)):
                at -= 1
            if at:
                yield every.slice(0, at)
            held = [every.slice(at)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    for table in _groups(batches, ["conv_id"]):
        con.register("batch", table)
        con.execute(TURNS)
        con.execute("CREATE OR REPLACE TEMP TABLE begun AS SELECT DISTINCT g, 0 AS start FROM turns")
        yield from con.sql(REPAIRED).to_arrow_table().to_batches()
    con.close()


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with role and text filled, the role's initial, and whether the text is blank and ends as a sentence does."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    seen = F.expr(f"trim(TRAILING {SPACES} FROM text)")
    first = F.substring("role", 1, 1)
    filled = rows.withColumns({"role": one("role"), "text": one("text")})
    return filled.withColumns({"initial": F.when(first.isin("s", "u", "a"), first).otherwise("?"), "blank": seen == "", "ended": F.substring(seen, -1, 1).isin(".", "!", "?")})


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of every row after its damage; a dropped row stays as one that is gone, without role and text."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = one("role"), one("text")
    harm = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    spoilt = F.when(harm <= 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(harm == 0, "").when(harm == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"), (harm == 0).alias("gone"), harm.alias("__harm"))
    return rows.withColumn("__copy", F.explode(F.when(F.col("__harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__harm", "__copy")


def repair(rows: DataFrame, long: int = LONG, most_long: int = MOST_LONG) -> DataFrame:
    """Faults, cheapest cost, audit and the digest of the repaired turns of every conversation of `rows`.

    `rows` has conv_id, turn, role, text and gone (true for a row that only says that its conversation is there). Cheapest edits
    give roles ``(s?(ua)+)?``: keep a turn (0), change its role to user or assistant (3), delete it (4; blank and repeated turns have to go),
    insert an empty one (3); a truncated turn that is not deleted costs 3 more.
    """
    counts = rows.groupBy("conv_id").count()
    total, top = counts.agg(F.sum("count"), F.max("count")).first()
    least = max(long, (total or 0) // most_long)
    short = rows
    if (top or 0) > least:
        hot = cut(counts.filter(F.col("count") > least).select(F.col("conv_id").alias("__conv")))  # at most most_long rows
        same = F.col("conv_id").eqNullSafe(F.col("__conv"))
        short = rows.join(F.broadcast(hot), same, "left_anti")
    slim = _faults(short.select("conv_id", "turn", "role", "text", "gone")).repartition("conv_id").sortWithinPartitions("conv_id")
    done = slim.mapInArrow(_repair, f"conv_id long, {OUT}")
    if short is rows:
        return done
    return done.union(_repair_long(rows.join(F.broadcast(hot), same, "left_semi"), hot))


# long conversations: slim rows in order, segments of them, then segments of segments

UNIT = "conv_id long, seg long, moves array<struct<start: int, state: int, cost: long, audit: string>>, first string, last string, illegal long"

#: What a segment or a unit of several does to every state, with the initials at its ends and the illegal pairs in it.
ADVANCED = """,
size AS (SELECT g, max(i) AS n FROM turns GROUP BY g),
done AS (
  SELECT w.g, list({'start': w.start, 'state': w.state, 'cost': w.cost, 'audit': w.audit || $end}) AS moves
  FROM walk w JOIN size s ON s.g = w.g AND s.n = w.i GROUP BY w.g),
pairs AS (SELECT *, lag(last) OVER (PARTITION BY g ORDER BY i) || first NOT IN ('su', 'ua', 'au') AS wrong FROM turns),
joined AS (
  SELECT g, any_value(conv_id) AS conv_id, any_value(unit) AS unit, arg_min(first, i) AS first, arg_max(last, i) AS last,
         CAST(sum(within) + count(*) FILTER (wrong) AS BIGINT) AS illegal
  FROM pairs GROUP BY g)
SELECT j.conv_id, j.unit AS seg, d.moves, j.first, j.last, j.illegal FROM joined j JOIN done d ON d.g = j.g"""
BEGUN = "CREATE OR REPLACE TEMP TABLE begun AS SELECT DISTINCT g, unnest([0, 1, 2, 3]) AS start FROM turns"


def _units(bits: int, rows: bool):
    """The recursion over slim rows, or over units below, of each group of 2**bits neighbours."""
    numbered = f"SELECT dense_rank() OVER (ORDER BY conv_id, seg >> {bits}) AS g, seg >> {bits} AS unit, * FROM batch"
    columns = "kind, initial, copies, initial AS first, initial AS last, copies - 1 AS within" if rows else "moves, first, last, illegal AS within"
    turns = f"CREATE OR REPLACE TEMP TABLE turns AS SELECT g, unit, conv_id, row_number() OVER (PARTITION BY g ORDER BY seg) AS i, {columns} FROM ({numbered})"
    walk = WALK % BY_KIND if rows else (WALK % "m.g = t.g AND m.i = t.i").replace("JOIN moves m", "JOIN below m")
    if rows:  # further copies of a row are deleted behind it
        walk = walk.replace("w.cost + m.cost", f"w.cost + m.cost + {DELETE} * (t.copies - 1)").replace("|| m.said", "|| m.said || repeat('D', t.copies - 1)")
    query = walk + ADVANCED.replace("$end", "'|'" if rows else "''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for table in _groups(batches, ["conv_id", "group"]):
            con.register("batch", table)
            con.execute(turns)
            con.execute(BEGUN)
            if not rows:
                con.execute('CREATE OR REPLACE TEMP TABLE below AS SELECT g, i, m.start AS state, m.state AS "to", m.cost AS cost, m.audit AS said FROM (SELECT g, i, unnest(moves) AS m FROM turns)')
            yield from con.sql(query).to_arrow_table().to_batches()
        con.close()

    return run


def _grouped(units: DataFrame, bits: int) -> DataFrame:
    """Neighbours hashed together by conversation and group, in order."""
    return units.withColumn("group", F.shiftright("seg", bits)).repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "seg")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each conversation's blocks, which come in order; the first line end is left out."""
    out: list[tuple] = []
    name, sha, begun = None, None, False
    for batch in batches:
        for conv, block in zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if sha is None or conv != name:
                if sha is not None:
                    out.append((name, sha.hexdigest()))
                name, sha, begun = conv, hashlib.sha256(), False
            data = block.encode()
            sha.update(data if begun else data[1:])
            begun = begun or bool(data)
    if sha is not None:
        out.append((name, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])


def _on(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, same, how).drop(*(f"__{k}" for k in keys))


def _lines(inserted: Column) -> Column:
    return F.replace(F.replace(inserted, F.lit("Iu"), F.lit("\nuser:")), F.lit("Ia"), F.lit("\nassistant:"))


def _repair_long(rows: DataFrame, hot: DataFrame) -> DataFrame:
    full = _faults(rows.filter(~F.col("gone")).select("conv_id", "turn", "role", "text"))
    full = full.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("head", F.substring("text", 1, 64))
    names = ["conv_id", "turn", "role", "digest"]
    slim = full.groupBy(*names).agg(F.first("head").alias("head"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("ended").alias("ended"), F.count("*").alias("copies"))
    placed = cut(slim.repartitionByRange("conv_id", "turn", "role", "head", "digest").sortWithinPartitions("conv_id", "turn", "role", "head", "digest").withColumn("seg", F.monotonically_increasing_id()))
    new = placed.groupBy("conv_id", "role", "digest").agg(F.min("seg").alias("seg")).select("seg", F.lit(True).alias("new"))
    marked = placed.join(new, "seg", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    kind = F.when(F.col("blank") | ~F.col("new"), "d").when(F.col("ended"), "k").otherwise("t")
    marked = cut(marked.withColumn("kind", kind).drop("head"))

    units = cut(_grouped(marked.select("conv_id", "seg", "kind", "initial", "copies"), SEGMENT_BITS).mapInArrow(_units(SEGMENT_BITS, True), UNIT))
    segments = units.select("conv_id", "seg")
    for bits in _levels(marked):
        units = cut(_grouped(units, bits).mapInArrow(_units(bits, False), UNIT))

    ends = F.create_map(*(x for s, c, said in _ends() for x in (F.lit(s), F.struct(F.lit(c).cast("long").alias("cost"), F.lit(said).alias("said")))))
    closed = F.transform(F.filter("moves", lambda m: m["start"] == START), lambda m: F.struct((m["cost"] + ends[m["state"]]["cost"]).alias("cost"), F.concat(m["audit"], ends[m["state"]]["said"]).alias("audit")))
    best = cut(units.select("conv_id", "illegal", F.array_min(closed).alias("best")).select("conv_id", "illegal", "best.cost", "best.audit"))

    # the audit's pieces, one a segment, meet the segment's rows; a row's edit is its place's
    order = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list("seg")).alias("segs"))  # shorter than the audit beside it
    parts = F.split("audit", r"\|")
    pieces = _on(best, order, "conv_id").select("conv_id", F.explode(F.arrays_zip(F.col("segs").alias("segment"), parts.alias("piece"))).alias("p")).select("conv_id", "p.segment", "p.piece")
    tail = best.select("conv_id", _lines(F.regexp_extract("audit", "((?:I[ua])*)$", 1)).alias("block"), F.lit((1 << 63) - 1).alias("segment"))
    keyed = marked.withColumn("segment", F.shiftright("seg", SEGMENT_BITS))
    before = F.expr("sum(copies) OVER (PARTITION BY conv_id, segment ORDER BY seg) - copies")
    edits = F.regexp_extract_all("piece", F.lit("((?:I[ua])*(?:K|R[ua]|D))"), F.lit(1))
    edited = _on(keyed.withColumn("before", before), pieces.filter("segment IS NOT NULL"), "conv_id", "segment").withColumn("edit", F.get(edits, F.col("before").cast("int"))).select(*names, "segment", "seg", "edit")
    texts = full.groupBy(*names).agg(F.first("text").alias("text"))
    whole = _on(edited.filter(~F.col("edit").endswith("D")), texts, *names)
    speaker = F.when(F.col("edit").endswith("Ru"), "user").when(F.col("edit").endswith("Ra"), "assistant").otherwise(F.col("role"))
    line = F.concat(_lines(F.regexp_extract("edit", "^((?:I[ua])*)", 1)), F.lit("\n"), speaker, F.lit(":"), "text")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", line.alias("line")))), lambda x: x["line"]), "")  # a segment's rows at most
    blocks = whole.groupBy("conv_id", "segment").agg(joined.alias("block")).select("conv_id", "block", "segment")
    hashed = blocks.unionByName(tail).repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_streamed, "conv_id long, repaired_sha256 string")

    stats = marked.groupBy("conv_id").agg(
        F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("new").cast("int"))).alias("duplicate"), F.count_if(F.col("kind") == "t").alias("truncated"),
    )
    every = _on(_on(_on(hot.select(F.col("__conv").alias("conv_id")), stats, "conv_id", how="left"), best, "conv_id", how="left"), hashed, "conv_id", how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.select(
        "conv_id", zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.regexp_replace(F.coalesce("audit", F.lit("")), "[ua|]", "").alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _levels(placed: DataFrame) -> list[int]:
    """By how many bits the segments' numbers shrink from level to level, until each conversation is one unit.

    A number is a partition's and, in 33 bits, a row's in it; bits that no row uses are left out at once.
    """
    high, parts = placed.agg(F.max(F.col("seg").bitwiseAND((1 << 33) - 1)), F.max(F.shiftright("seg", 33))).first()
    out, left = [], 33 - SEGMENT_BITS
    used = max(0, int(high or 0).bit_length() - SEGMENT_BITS)
    while used > 0:
        out.append(min(SEGMENT_BITS, left))
        left -= out[-1]
        used -= SEGMENT_BITS
    parts = int(parts or 0).bit_length()
    while parts > 0:
        out.append(left + SEGMENT_BITS)
        left, parts = 0, parts - SEGMENT_BITS
    return out
