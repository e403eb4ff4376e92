"""Merkle dataset manifest by time-forward processing (operator 11).

Every document is a leaf; per language, FANOUT consecutive nodes hash to their parent until one is left (the subroot), and the subroots hash to the root the same way.
A node's label is the place of the last leaf under it, then its level, so children come before parents.  A task takes the nodes of one block (BLOCK consecutive
nodes of a tree) in label order: each sends its digest to its parent through a priority queue ordered by label, and a node is worked on when the sweep reaches its label.  The
queue between blocks is Spark's external sort: the blocks' tops are the next round's nodes, so a tree of N leaves takes log_512 N rounds and no task holds more than a
block.  The reversed sweep goes from the tops down: each node's proof suffix (its siblings, then its parent's suffix) goes to its children, block by block; what a
block of leaves shares is sent once a block, and leaves turn it into a hash and a folded root at once.

Rows: a null doc_id sorts first and counts as the empty text for tampering; nulls in other columns are hashed as `-`, so they differ from empty texts.  Equal doc_ids are
ordered by their leaf digest; repeated rows are leaves of their own with proofs of their own.  Whole texts are hashed, however long, by Spark; they are never shuffled.
Columns other than the five are ignored, whatever their names.  An empty table gives no rows.
"""
from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import shuffle_partitions, written

FANOUT = 8
LEVELS = 3
BLOCK = FANOUT**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts) -> str:
    """H: hex sha256 of the parts' UTF-8 bytes, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, lang, digest, tampered (the leaf that tampering makes; null where nothing is tampered with), salt."""
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    tampered = F.when(hit, leaf_digest(F.translate("text", UPPER, LOWER)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest(F.col("text")).alias("digest"), tampered.alias("tampered"), F.rand(11).alias("salt"))


def placed(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """Rows with their place 0, 1, ... in their tree, and the tree's size n.  Rows go to sorted ranges, which split a large tree; one row a range and tree tells how many come before."""
    ranges = nodes.repartitionByRange(shuffle_partitions(nodes.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    rows = written(ranges.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    count = rows.groupBy("range", F.col(tree).alias("of")).agg(F.min("at").alias("low"), F.count("*").alias("k"))
    w = W.partitionBy("of")
    starts = count.select(F.col("range").alias("part"), "of", "low", (F.sum("k").over(w.orderBy("range")) - F.col("k")).alias("before"), F.sum("k").over(w).alias("n"))
    met = rows.join(starts, (F.col("range") == F.col("part")) & F.col(tree).eqNullSafe(F.col("of")))
    return met.withColumn("place", F.col("at") - F.col("low") + F.col("before")).drop("at", "range", "part", "of", "low", "before")


def height(n: int) -> int:
    """Levels that a block of a tree (of now n nodes) is to be hashed up."""
    levels = 0
    while levels < LEVELS and n > 1:
        n = -(-n // FANOUT)
        levels += 1
    return levels


def sweep(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of a block's nodes, level by level.  Nodes are worked on in label order (last leaf, level); a child's digest waits for its parent in a priority queue."""
    out, queue = [list(digests), *[[] for _ in range(levels)]], []

    def send(place, level, d):
        if level < levels:
            up = place // FANOUT
            heapq.heappush(queue, ((up + 1) * FANOUT ** (level + 1) - 1, level + 1, up, place, d))

    def settle(before):
        while queue and queue[0][0] < before:
            _, level, place, _, d = heapq.heappop(queue)
            got = [d]
            while queue and queue[0][1:3] == (level, place):
                got.append(heapq.heappop(queue)[4])
            out[level].append(digest(got))
            send(place, level, out[level][-1])

    for p, d in enumerate(digests):
        settle(p)
        send(p, 0, d)
    settle(float("inf"))
    return out


def sweep_back(nodes: list[list[str]], suffix):
    """The reversed sweep: yields the proof suffix of each of a block's lowest nodes, left to right.  A suffix is a chain ((siblings left, siblings right), rest) from the node up; the
    block's top has the given one.  Parents deliver to children through a queue in reversed label order."""
    top = len(nodes) - 1
    queue = [(-(FANOUT**top - 1), -top, 0, suffix)]
    lowest = [None] * len(nodes[0])
    while queue:
        _, level, place, chain = heapq.heappop(queue)
        level = -level
        if level == 0:
            lowest[place] = chain
            continue
        run = nodes[level - 1][place * FANOUT : (place + 1) * FANOUT]
        for i in range(len(run)):
            child = place * FANOUT + i
            mine = (("".join(run[:i]), "".join(run[i + 1 :])), chain)
            heapq.heappush(queue, (-((child + 1) * FANOUT ** (level - 1) - 1), 1 - level, child, mine))
    return lowest


def unchained(chain) -> tuple[list[str], list[str]]:
    left, right = [], []
    while chain is not None:
        (a, b), chain = chain
        left.append(a)
        right.append(b)
    return left, right


def chained(left, right):
    chain = None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        chain = ((a, b), chain)
    return chain


def fold(d: str, chain) -> str:
    while chain is not None:
        (a, b), chain = chain
        d = digest((a, d, b))
    return d


def proof(chain) -> str:
    """H of the siblings, level by level."""
    h = sha256()
    while chain is not None:
        (a, b), chain = chain
        h.update(a.encode())
        h.update(b.encode())
    return h.hexdigest()


def _blocks(batches):
    """The rows of each block (tree, block), which come one after the other, in order of place."""
    key, held = None, []
    for b in batches:
        for r in b.to_pylist():
            k = (r["tree"], r["place"] // BLOCK)
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(r)
    if held:
        yield key, held


def _by_block(nodes: DataFrame) -> DataFrame:
    block = (F.col("place") / BLOCK).cast("long")
    return nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "place").drop("block")


TOP = "tree string, place long, n long, digest string"


def _climbed(batches):
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    for (tree, block), rows in _blocks(batches):
        n = rows[0]["n"]
        top = sweep([r["digest"] for r in rows], height(n))[-1]
        yield pa.RecordBatch.from_pylist([{"tree": tree, "place": block, "n": -(-n // BLOCK), "digest": top[0]}], schema=schema)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of nodes(tree, place, n, digest): the given ones, the tops of their blocks, and so on up to one node a tree."""
    rounds = [nodes]
    n = nodes.agg(F.max("n")).head()[0] or 0
    while n > 1:
        rounds.append(written(_by_block(rounds[-1].select("tree", "place", "n", "digest")).mapInArrow(_climbed, TOP)))
        n = -(-n // BLOCK)
    return rounds


SUFFIX = "left array<string>, right array<string>"


def _suffixes(batches):
    """Rows of a block with `up` (the suffix of its top) -> tree, place, left, right."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
    for (tree, _), rows in _blocks(batches):
        up = next(r["up"] for r in rows if r["up"] is not None)
        chains = sweep_back(sweep([r["digest"] for r in rows], height(rows[0]["n"])), chained(up["left"], up["right"]))
        out = [dict(zip(("left", "right"), unchained(c), strict=True), tree=tree, place=r["place"]) for r, c in zip(rows, chains, strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _checked(batches):
    """Rows of a block of leaves -> the manifest's rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    for _, rows in _blocks(batches):
        head = next(r for r in rows if r["up"] is not None)
        subroot, root, up = head["subroot"], head["root"], head["up"]
        chains = sweep_back(sweep([r["digest"] for r in rows], height(rows[0]["n"])), chained(up["left"], up["right"]))
        out = []
        for r, chain in zip(rows, chains, strict=True):
            folded = fold(r["tampered"] or r["digest"], chain)
            out.append({"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": subroot, "root": root, "proof_sha256": proof(chain), "folded_root": folded, "verified": folded == root})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _under(nodes: DataFrame, tops: DataFrame, *more: str) -> DataFrame:
    """Nodes with what their block's top has; only the block's first row carries it, so that it is not sent once a node."""
    first = (F.col("place") % BLOCK) == 0
    side = tops.select(F.col("tree").alias("of"), (F.col("place") * BLOCK).alias("first"), F.struct("left", "right").alias("up"), *more)
    heads = nodes.where(first).join(side, F.col("tree").eqNullSafe(F.col("of")) & (F.col("place") == F.col("first"))).drop("of", "first")
    none = {"up": F.lit(None).cast("struct<left: array<string>, right: array<string>>"), **{c: F.lit(None).cast("string") for c in more}}
    rest = nodes.where(~first).withColumns(none)
    return heads.unionByName(rest)


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, place, left, right) of the blocks' tops over the lowest round, from those of the trees' tops (tree, place 0, left, right)."""
    for nodes in reversed(rounds[1:-1]):
        tops = written(_by_block(_under(nodes, tops)).mapInArrow(_suffixes, f"tree string, place long, {SUFFIX}"))
    return tops


def manifest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row a document."""
    low = written(placed(written(leaves(docs)), "lang", "doc_id", "digest", "salt").withColumnRenamed("lang", "tree").drop("salt"))
    rounds = climb(low)
    subroots = written(rounds[-1].select(F.col("tree").alias("lang"), "digest"))  # one row a language
    over = placed(subroots.withColumn("tree", F.lit("")), "tree", "lang")
    heads = written(over)
    upper = climb(heads)
    whole = written(upper[-1].select("digest"))  # one row, or none for an empty table
    none = F.array().cast("array<string>")
    up = descend(upper, upper[-1].select("tree", "place", none.alias("left"), none.alias("right")))
    up = written(_by_block(_under(heads, up)).mapInArrow(_suffixes, f"tree string, place long, {SUFFIX}")) if len(upper) > 1 else up
    langs = heads.join(up.drop("tree"), "place").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), "left", "right")
    tops = descend(rounds, langs)
    named = subroots.join(F.broadcast(whole.select(F.col("digest").alias("root")))).select(F.col("lang").alias("name"), F.col("digest").alias("subroot"), "root")
    tops = tops.join(named, F.col("tree").eqNullSafe(F.col("name"))).drop("name")
    return _by_block(_under(low, tops, "subroot", "root")).mapInArrow(_checked, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
