"""Query of operator 1: quality rules over all documents."""
from .common import table
from .quality import judge, language_references


def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, language_references(docs))
