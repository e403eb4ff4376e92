"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> docs; the last one returns packed pieces."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing, op4, pii, quality
from .common import WORD, discard, narrow_batches, recorded, written
from .jaccard import BROADCAST_IDS, jaccard_rows


def _few(ids):
    """A table of ids marked for broadcast if it has at most BROADCAST_IDS rows, so that texts need no shuffle; beyond that the join shuffles."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    narrow_batches(spark)
    return quality.keep_good(docs, quality.language_references(docs))


def _with_rows(docs):
    """The documents, written, each whole in a column `d` beside a unique row id `r`: doc_ids may be null or repeated, and columns may have any name."""
    return written(docs.select(F.struct(*docs.columns).alias("d"), F.monotonically_increasing_id().alias("r")))


def near_duplicates(spark, docs, sf_dir):
    """One row of each group stays: the one with the least doc_id (null last), then the least hash of its text; rows without words stand alone."""
    rows = _with_rows(docs)
    with recorded() as tables:
        found = jaccard_rows(rows.select("d.doc_id", "d.text", F.col("r").alias("__row")))
    found = written(found)
    discard(spark, tables)
    grouped = found.where("comp is not null").join(rows.select(F.col("r").alias("u"), F.xxhash64("d.text").alias("hash")), "u")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "u")
    first = grouped.groupBy("comp").agg(F.min(order).alias("first")).select(F.col("first.u").alias("r"))
    kept = _few(written(first.unionByName(found.where("comp is null").select(F.col("u").alias("r")))))
    return rows.join(kept, "r", "left_semi").select("d.*")


def personal_data(spark, docs, sf_dir):
    """Spans of personal data give way to their kind in angle brackets; no document goes."""
    narrow_batches(spark)
    return pii.redact(docs, pii.train(docs))


def mixed_sources(spark, docs, sf_dir):
    """Each row once per epoch that deals its blocks, whole, and its first words (with the white space between them) where the dealt blocks of the last epoch end inside it; in the
    order in which the schedule deals the blocks that they begin in.  n_chars follows the text."""
    whole = _with_rows(docs)
    with recorded() as tables:
        took = mixing.taken(whole.select("d.doc_id", "d.source", "d.text", F.col("r").alias("__row")))
    took = written(took.where("taken > 0").select(F.col("__row").alias("r"), "size", "taken", "slots"))
    discard(spark, tables)
    met = whole.join(_few(took), "r").select("d", "size", "taken", F.posexplode("slots").alias("epoch", "slot"))
    rest = (F.col("taken") - F.col("epoch") * F.col("size")).cast("int")
    words, blanks = F.regexp_extract_all("d.text", F.lit(WORD), F.lit(0)), F.split("d.text", WORD)
    part = F.array_join(F.zip_with(F.slice(blanks, F.lit(1), rest), F.slice(words, F.lit(1), rest), lambda blank, word: F.concat(blank, word)), "")
    text = F.when(rest >= F.col("size"), F.col("d.text")).otherwise(part)
    cols = {"text": text, "n_chars": F.length(text).cast("long")}
    rows = met.repartitionByRange("slot").sortWithinPartitions("slot")
    return rows.select(*[cols[c].alias(c) if c in cols else F.col(f"d.`{c}`") for c in docs.columns])


def packed(spark, docs, sf_dir):
    """Packed pieces with their digests."""
    narrow_batches(spark)
    return op4.digest(op4.pieces(docs))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("mixing sources", mixed_sources), ("packing", packed)]
