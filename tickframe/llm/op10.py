"""Query of operator 10: personal data in all documents."""
from .common import table
from .pii import spans, train


def op10_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spans(docs, train(docs))
