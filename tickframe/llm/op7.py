"""Query of operator 7: toxicity of every document, learned from the labels outside fold 2."""
from pyspark.sql import functions as F

from .common import crc_fold, table
from .toxicity import score, train

THRESHOLD = 0.3
BROADCAST_IDS = 1_000_000


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    few = labels.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # else the texts are shuffled to their labels
    model = train(docs.select("doc_id", "text").join(F.broadcast(labels) if few else labels, "doc_id"))
    return score(docs, model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
