"""Chat formatting from reply trees (operator 8), DataFrame functions only.

A message tree has rows (tree, node, parent, role, text, score).  Path enumeration is by iterative self-joins that double the jump length: after k
rounds each node knows its ancestor 2^k steps up and the score sum on the way, so depth d needs log2(d) joins.  Leaves are ranked by the mean
score of their root-to-leaf path (ties: the lesser leaf id); the `keep` best branches of a tree are walked up the same way, and
each chosen path becomes one conversation.  Nodes whose parent is missing are roots; nodes on a cycle reach no root and belong to no path.

Template: every turn is `<|turn|>role\\n`, the text, `<|end|>\\n`.  Texts and roles are escaped: a backslash goes before each control string, and backslashes
that stand before one (or at the end of the text) are doubled; `unescape` undoes it exactly.  The loss mask is an array of
code-point spans (start, length) that cover the assistants' texts as formatted.  Null texts and roles are empty; repeated rows are turns
of their own; an empty table gives no rows.  Rows that share tree and node follow each other, by role, text and score, in that node's place: the first replies to the node's parent, each further one to
the one before it, and the node's replies to the last.  Texts may be of any length; other columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import written

#: Strings that a text may not pass on unescaped: fixed values of this template and of common ones.
CONTROLS = ["<|turn|>", "<|end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ANY = "|".join(c.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"(\\+)(?={_ANY}|\z)", "$1$1"), rf"({_ANY})", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\\({_ANY})", "$1"), rf"(\\+)\1(?={_ANY}|\z)", "$1")


def _chains(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, node, up (the ancestor reached; null past the root), n and total (count and score sum of the nodes passed)."""
    here = nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"))
    for k in range(max(1, math.ceil(math.log2(depth + 1)))):
        step = here.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        here = here.join(step, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))
        if k % 3 == 2:
            here = written(here)
    return here


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, node, depth: the nodes of the `keep` best root-to-leaf paths of each tree."""
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("has")).distinct()
    nodes = messages.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left")
    nodes = written(nodes.select("tree", "node", F.when(F.col("has"), F.col("parent")).alias("parent"), "score"))
    depth = nodes.groupBy("tree").count().agg(F.max("count")).head()[0] or 1
    ends = _chains(nodes, depth).where("up is null")
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = ends.join(parents, ["tree", "node"], "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    # walk up from the chosen leaves by doubling: each round joins what is known of a path with jumps of its length
    paths = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("n").alias("depth"))
    jump = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("to"))
    length = 1
    while length < depth:
        paths = paths.unionByName(paths.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("to").alias("node"), (F.col("depth") - length).alias("depth")))
        jump = jump.join(jump.select("tree", F.col("node").alias("to"), F.col("to").alias("to2")), ["tree", "to"]).select("tree", "node", F.col("to2").alias("to"))
        length *= 2
        if length in (8, 64, 512, 4096, 1 << 15, 1 << 18):
            paths, jump = written(paths), written(jump)
    return paths


def chained_copies(messages: DataFrame) -> DataFrame:
    """Messages whose nodes are (node, copy): rows that share tree and node become a chain."""
    w = W.partitionBy("tree", "node")
    m = messages.withColumn("copy", F.row_number().over(w.orderBy("role", "text", "score", "parent")))
    last = messages.groupBy("tree", F.col("node").alias("parent")).agg(F.count("*").cast("int").alias("last"))
    m = m.join(last, ["tree", "parent"], "left")
    up = F.when(F.col("copy") > 1, F.struct("node", (F.col("copy") - 1).alias("copy"))).when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), F.coalesce("last", F.lit(1)).alias("copy")))
    return m.select("tree", F.struct("node", "copy").alias("node"), up.alias("parent"), "role", "text", "score")


def turns_as_tree(rows: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees: each row replies to the one before it (ties by role, then text)."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    t = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("node", F.row_number().over(w).cast("long"))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return t.select(key.alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"), "conv_id")


def formatted(messages: DataFrame, keep: int = 1, distinct: bool = False) -> DataFrame:
    """messages -> tree, rank, formatted, loss (array of (start, length) in code points).  `distinct` says that no two rows share tree and node (as after `turns_as_tree`)."""
    messages = messages if distinct else chained_copies(messages)
    messages = messages.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    path = best_paths(messages, keep).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = escape(F.col("role")), escape(F.col("text"))
    path = path.select("tree", "rank", "depth", F.concat(F.lit("<|turn|>"), role, F.lit("\n")).alias("head"), text.alias("body"), (F.col("role") == "assistant").alias("learn"))
    end = "<|end|>\n"
    before = F.sum(F.length("head") + F.length("body") + len(end)).over(W.partitionBy("tree", "rank").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    path = path.withColumn("at", F.coalesce(before, F.lit(0)) + F.length("head"))
    turns = F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(end)).alias("turn"))))
    spans = F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))))
    return path.groupBy("tree", "rank").agg(turns.alias("t"), spans.alias("loss")).select("tree", "rank", F.array_join(F.col("t.turn"), "").alias("formatted"), "loss")


def read_back(chats: DataFrame) -> DataFrame:
    """Turns parsed from the formatted text: tree, rank, pos, role, text, and masked: what the loss mask covers of the turn, unescaped."""
    marks = r"(?<!\\)<\|turn\|>"
    t = chats.select("tree", "rank", "loss", F.posexplode(F.split("formatted", marks)).alias("pos", "turn")).where("pos > 0")
    at = F.sum(F.length("turn") + len("<|turn|>")).over(W.partitionBy("tree", "rank").orderBy("pos")) - F.length("turn")
    t = t.withColumn("at", at).withColumn("head", F.instr("turn", "\n"))
    text = F.expr("substring(turn, head + 1, length(turn) - head - length('<|end|>\\n'))")
    mask = chats.select("tree", "rank", F.explode("loss").alias("span")).select("tree", "rank", F.col("span.start").alias("begin"), F.col("span.length").alias("len"))
    t = t.withColumn("begin", F.col("at") + F.col("head")).join(mask, ["tree", "rank", "begin"], "left")
    covered = F.expr("substring(turn, head + 1, cast(len as int))")
    return t.select("tree", "rank", "pos", unescape(F.expr("substring(turn, 1, head - 1)")).alias("role"), unescape(text).alias("text"), F.when(F.col("len").isNotNull(), unescape(covered)).alias("masked"))
