"""Query of operator 4: all documents packed into sequences of 1024 tokens."""
from pyspark.sql import functions as F

from .common import table
from .packing import pack


def pieces(docs):
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def digest(packed):
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pack_windows(spark, sf_dir):
    return digest(pieces(table(spark, sf_dir, "documents")))
