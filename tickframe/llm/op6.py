"""Query of operator 6: fingerprints of all documents and of their edited texts."""
from .common import table
from .fingerprint import fingerprints


def op6_multiset_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
