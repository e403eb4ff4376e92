"""Query of operator 5: language of every document, learned from the folds 0 and 2."""
from pyspark.sql import functions as F

from .common import crc_fold, table
from .langid import predict, train


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_fold("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
