"""Chat formatting: root-to-leaf paths of reply trees as conversations, in DataFrame operations only.

Paths are enumerated by iterative self-joins that double their reach: after k joins every node knows its ancestor 2^k
replies up and the scores on the way, so trees of depth d take log2(d) rounds. Of each tree's leaves, branches are ranked by
the mean score of their messages; each chosen path is then written out and becomes one conversation.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is doubled and
``<|`` becomes ``<\\|``, so only the template's own marks hold ``<|``; a line end in a role becomes ``<\\n|``.
Reading back is a split at the marks and the reverse replacements.

Defined results: null texts and roles are empty; null scores count as 0; ties of branches go to the smaller leaf id; a
message whose parent is missing is a root; ids of different trees have nothing to do with each other; a null tree is one tree; a
message without an id is one of its own, which can have no replies; of rows that repeat a message id of one tree the least by
parent, role, text and score counts; messages on a cycle, or under one, have no root and give no path; other columns are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def _same_tree(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Who has an ancestor 2^k replies up, which, and the sum of scores on the way; and who never comes to a root.

    nodes: tree, node, parent (null for roots), score. Each table joins the one before it with itself, and has fewer rows.
    """
    known = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("far"))
    first = nodes.join(known, _same_tree("tree", "_tree") & (F.col("parent") == F.col("far")))
    out = [cut(first.select("tree", "node", "far", F.col("score").alias("total")))]
    longest, step = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    while not out[-1].isEmpty():
        if step > longest:  # ancestors without end: these stand on a cycle, or under one
            return out[:-1], out[-1]
        further = out[-1].select(F.col("tree").alias("_tree"), F.col("node").alias("via"), F.col("far").alias("_far"), F.col("total").alias("_total"))
        both = out[-1].join(further, _same_tree("tree", "_tree") & (F.col("far") == F.col("via")))
        out.append(cut(both.select("tree", "node", F.col("_far").alias("far"), (F.col("total") + F.col("_total")).alias("total"))))
        step *= 2
    return out[:-1], None


def branches(nodes: DataFrame, up: list[DataFrame], endless: DataFrame | None) -> DataFrame:
    """tree, leaf and mean score of every root-to-leaf path, without its nodes."""
    replied = nodes.filter("parent is not null").select(F.col("tree").alias("_tree"), F.col("parent").alias("inner")).distinct()
    at = nodes.join(replied, _same_tree("tree", "_tree") & (F.col("node") == F.col("inner")), "left_anti")
    if endless is not None:
        lost = endless.select(F.col("tree").alias("_tree"), F.col("node").alias("lost"))
        at = at.join(lost, _same_tree("tree", "_tree") & (F.col("node") == F.col("lost")), "left_anti")
    at = at.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("sum"), F.lit(1).alias("n"))
    for k in reversed(range(len(up))):
        jump = up[k].select(F.col("tree").alias("_tree"), F.col("node").alias("via"), "far", "total")
        at = at.join(jump, _same_tree("tree", "_tree") & (F.col("at") == F.col("via")), "left")
        at = at.select("tree", "leaf", F.coalesce("far", "at").alias("at"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"), (F.col("n") + F.when(F.col("far").isNotNull(), 2**k).otherwise(0)).alias("n"))
    root = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("root"), "score")
    done = at.join(root, _same_tree("tree", "_tree") & F.col("at").eqNullSafe(F.col("root")))
    return done.select("tree", "leaf", ((F.col("sum") + F.col("score")) / F.col("n")).alias("branch"))


def walks(chosen: DataFrame, up: list[DataFrame]) -> DataFrame:
    """`chosen` (tree, leaf, rank) with node and up (replies from the leaf to the node) of each node of the leaf's path."""
    reach = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    for k, jump in enumerate(up):
        further = jump.select(F.col("tree").alias("_tree"), F.col("node").alias("via"), "far")
        above = reach.join(further, _same_tree("tree", "_tree") & (F.col("node") == F.col("via")))
        reach = cut(reach.union(above.select("tree", "leaf", "rank", F.col("far").alias("node"), (F.col("up") + 2**k).alias("up"))))
    return reach


def distinct_messages(messages: DataFrame) -> DataFrame:
    """Nulls filled, and of rows that repeat a message id of one tree the least by parent, role, text and score.

    node and parent become (id, name): a message without an id is named by what it says and a number, so none is lost.
    """
    filled = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    named = lambda id, name: F.struct(F.col(id).alias("id"), name.cast("string").alias("name"))
    above = F.when(F.col("parent").isNotNull(), named("parent", F.lit(None)))
    least = filled.filter("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("least")).select("tree", "node", "least.*")
    known = least.select("tree", named("node", F.lit(None)).alias("node"), above.alias("parent"), "role", "text", "score")
    nameless = filled.filter("node is null").groupBy("tree", "node", "parent", "role", "text", "score").agg(F.count("*").cast("int").alias("copies"))
    digest = F.sha2(F.to_json(F.struct("parent", "role", "text", "score")).cast("binary"), 256)
    nameless = nameless.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return known.union(nameless.select("tree", named("node", F.concat_ws(":", digest, F.col("copy").cast("string"))).alias("node"), above.alias("parent"), "role", "text", "score"))


def format_trees(messages: DataFrame, top: int | None = 1, skeleton: DataFrame | None = None) -> DataFrame:
    """One conversation for each of a tree's `top` best branches (None: all).

    messages: tree, node, parent, role, text, score. Returns tree, leaf, rank (from 1), n_turns, formatted and
    loss_spans, the code point ranges [start, end) of `formatted` that carry the assistant's texts. Slim rows find and
    rank the paths; only those of chosen leaves are written out, and texts come in last. `skeleton` is the tree, node,
    parent and score of all messages with ids that don't repeat, where these can be had without their texts.
    """
    turns = distinct_messages(messages) if skeleton is None else messages
    nodes = cut((turns if skeleton is None else skeleton).select("tree", "node", "parent", "score"))
    up, endless = jumps(nodes)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch"), "leaf"))
    chosen = branches(nodes, up, endless).withColumn("rank", rank)
    if top is not None:
        chosen = chosen.filter(F.col("rank") <= top)
    path = walks(cut(chosen.select("tree", "leaf", "rank")), up)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    said = turns.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.concat(head, escape(text), F.lit(END)).alias("turn"), (role == LEARNT).alias("learnt"), F.char_length(head).alias("before"))
    placed = path.join(said, _same_tree("tree", "_tree") & F.col("node").eqNullSafe(F.col("_node"))).withColumn("chars", F.char_length("turn"))
    w = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    placed = placed.withColumn("begin", F.sum("chars").over(w) - F.col("chars"))
    span = F.when(F.col("learnt"), F.struct((F.col("begin") + F.col("before")).cast("long").alias("start"), (F.col("begin") + F.col("chars") - len(END)).cast("long").alias("end")))
    rows = placed.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("begin", "turn"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    leaf = F.col("leaf")["id"].alias("leaf") if skeleton is None else F.col("leaf")
    return rows.select("tree", leaf, "rank", "n_turns", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: t != "")
    body = lambda t: F.substring(t, len(START) + 1, 1 << 30)
    role = lambda b: F.substring_index(b, "\n", 1)

    def turn(t: Column) -> Column:
        b = body(t)
        return F.struct(unescape_role(role(b)).alias("role"), unescape(b.substr(F.char_length(role(b)) + 2, F.lit(1 << 30))).alias("text"))

    return F.transform(parts, turn)


def learnt_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped text under each loss span."""
    return F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def _chain(conversations: DataFrame, order: list[str], *more: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    turns = conversations.select("conv_id", *more, nth.alias("node"))
    return turns.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), *more, F.lit(0.0).alias("score"))


def conversations_as_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of turns as reply trees without branches, each turn a reply to the one before it, and their skeleton.

    Turns of one number are ordered by role and text, nulls first; the skeleton doesn't depend on that order.
    """
    return _chain(conversations, ["turn", "role", "text"], "role", "text"), _chain(conversations, ["turn"])
