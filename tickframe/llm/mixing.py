"""Mixing sources to target weights by a low-discrepancy schedule (operator 2).

Slots 0, 1, 2, ... of the mix get golden-ratio points; the cumulative shares of the sources map a point to a source; slots are
ranked per source, and the r-th slot of a source takes the r-th block of its shuffled stream, epoch after epoch.  A stream is all texts of the
source in md5 order of their ids and texts, cut into blocks of BLOCK words (the last one of an epoch may be shorter).  What a source gives is what the points
deal to it: its share counts the blocks that its target needs, and the points keep each source within a few blocks of that at every length of the mix.
Slots past `max_epochs` rounds of a stream take nothing.  Targets share out all words by weight, stop at `max_epochs` times the size of
their source, and the excess is shared again by weight (the level is found in closed form from running sums over the sources in order of
size over weight).

No window covers a source or all sources: running sums over the sources go by sorted ranges, running positions come from sums per (source, md5
prefix) and inside such a bucket, ranks from sums per (source, slot chunk).  A null source is a source of its own (last in order); null and empty texts have size
0 and take 0; repeated rows are texts of their own, in any order among themselves; very long texts span many blocks; a source without words has target 0; extra
columns are ignored.  An empty table gives empty results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, shuffle_partitions, written

BLOCK = 64
BUCKET_ROWS = 4096
SLOT_CHUNK = 1 << 16
CELLS = 1024
#: frac(golden ratio), and frac(2^20 * golden ratio): high and low slot bits apart keep doubles exact enough.
PHI, PHI20 = 0.6180339887498949, (0.6180339887498949 * (1 << 20)) % 1.0
SEED = "mix"
#: The unique id of a row, where the caller has one.
ROW = ("__row",)


def _row(df: DataFrame) -> list[str]:
    return [c for c in ROW if c in df.columns]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, md5 order key; the row id goes along where docs has one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat(text("doc_id"), F.lit(f"#{SEED}#"), F.md5(text("text").cast("binary"))).cast("binary"))
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("h"), *_row(docs))


def source_key(c="source"):
    return F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("s"), c))


def running(df: DataFrame, order: list, **sums) -> DataFrame:
    """df with the running sum (this row included) of each given column over all rows in an order without ties, and its total in <name>_all.  Rows go to
    sorted ranges; the sums of the ranges before come from one row a range."""
    spark = df.sparkSession
    df = written(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__range", F.spark_partition_id()))
    per = df.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    upto, every = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1), W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select("__range", *[F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(f"__{n}") for n in sums], *[F.sum(f"__{n}").over(every).alias(f"{n}_all") for n in sums])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    return own.join(F.broadcast(per), "__range").withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def targets(sized: DataFrame, max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """One row per source: key, rank, weight, source_size, target, blocks of its stream, slots of its target, bounds lo/hi of its points, slots of the mix,
    `most` slots it can serve."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], rank=F.lit(1)).drop("rank_all")
    per = per.withColumn("weight", ((F.col("rank") - 1) % cycle + 1).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    per = running(per, [F.col("cap") / F.col("weight"), F.col("rank")], caps=F.col("cap"), weights=F.col("weight"), words=F.col("source_size"))
    rest = F.col("words_all") - (F.col("caps") - F.col("cap"))
    per = written(per.withColumn("level", rest.cast("double") / (F.col("weights_all") - (F.col("weights") - F.col("weight")))))
    # the first source in this order that stays below its cap sets the level of all after it
    level = per.where(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "rank")).alias("at"))
    per = per.join(F.broadcast(level)).withColumn("target", F.round(F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap").cast("double"))), 6))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    per = per.withColumn("slots", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * F.col("blocks") + 0.5), F.lit(0)))
    per = running(per.select("source", "rank", "weight", "source_size", "target", "blocks", "slots"), ["rank"], hi=F.col("slots")).withColumnRenamed("hi_all", "total")
    lo, hi = F.try_divide((F.col("hi") - F.col("slots")).cast("double"), "total"), F.when(F.col("hi") == F.col("total"), 2.0).otherwise(F.try_divide(F.col("hi").cast("double"), "total"))
    return per.select(source_key().alias("key"), "rank", "weight", "source_size", "target", "blocks", "slots", lo.alias("lo"), hi.alias("hi"), "total", (F.col("blocks") * max_epochs).alias("most"))


def streams(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Each text with its place [begin, end) in the shuffled stream of its source."""
    n = sized.count()
    digits = 0
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    docs = sized.withColumn("key", source_key()).withColumn("bucket", F.substring("h", 1, digits) if digits else F.lit(""))
    per = docs.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    per = per.withColumn("base", F.sum("n").over(W.partitionBy("key").orderBy("bucket")) - F.col("n")).join(goals, "key")
    inside = W.partitionBy("key", "bucket").orderBy("h", "size", *_row(docs)).rowsBetween(W.unboundedPreceding, 0)
    end = F.col("base") + F.sum("size").over(inside)
    return docs.join(per.drop("n"), ["key", "bucket"]).withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))


def schedule(goals: DataFrame) -> DataFrame:
    """The mix: slot, key (source), epoch, block of the source's stream."""
    spark = goals.sparkSession
    top = goals.agg(F.max("total")).head()[0] or 0
    low, high = F.col("slot") % (1 << 20), F.floor(F.col("slot") / (1 << 20))
    point = ((low * PHI) % 1.0 + (high * PHI20) % 1.0) % 1.0
    n = max(CELLS, top // SLOT_CHUNK)  # cells of the unit interval, each with as many points whatever the length of the mix
    slots = spark.range(top).select(F.col("id").alias("slot")).select("slot", point.alias("p")).withColumn("cell", F.floor(F.col("p") * n))
    cells = goals.where("slots > 0").select("key", "blocks", "most", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * n), F.least(F.floor(F.col("hi") * n), F.lit(n - 1)))).alias("cell"))
    drawn = slots.join(cells, "cell").where("p >= lo and p < hi").select("slot", "key", "blocks", "most", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    per = drawn.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    per = per.select("key", "chunk", (F.sum("n").over(W.partitionBy("key").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = drawn.join(per, ["key", "chunk"]).withColumn("r", F.col("base") + F.row_number().over(W.partitionBy("key", "chunk").orderBy("slot")) - 1)
    return ranked.where("r < most").select("slot", "key", F.floor(F.col("r") / F.col("blocks")).alias("epoch"), (F.col("r") % F.col("blocks")).alias("block"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, begin, taken, slots (of the block it begins in, by epoch: at most max_epochs), n_slots (that take words of it; repeats
    count), and __row: the schedule joined with the blocks of the streams."""
    sized = written(sizes(docs))
    row = _row(docs)
    goals = written(targets(sized))
    placed = written(streams(sized, goals.select("key", "source_size", "target")).select("doc_id", "source", "key", "size", "source_size", "target", "begin", "end", *row))
    dealt = schedule(goals).groupBy("key", "block").agg(F.array_sort(F.collect_list("slot")).alias("at"))
    first_block = F.floor(F.col("begin") / BLOCK)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first_block, F.floor((F.col("end") - 1) / BLOCK))))
    words = F.least("end", (F.col("block") + 1) * BLOCK) - F.greatest("begin", F.col("block") * BLOCK)
    met = pieces.join(dealt, ["key", "block"], "left").withColumn("times", F.coalesce(F.size("at"), F.lit(0)).cast("long"))
    out = met.groupBy("doc_id", "source", "begin", "size", "source_size", "target", *row).agg(
        F.sum(words * F.col("times")).alias("taken"), F.first(F.when(F.col("block") == first_block, F.col("at")), ignorenulls=True).alias("slots"), F.sum("times").alias("n_slots"))
    none = placed.where("size = 0").select("doc_id", "source", "begin", "size", "source_size", "target", *row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("array<bigint>").alias("slots"), F.lit(0).cast("long").alias("n_slots"))
    return out.unionByName(none)
