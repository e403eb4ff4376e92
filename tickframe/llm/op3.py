"""Query of operator 3: perplexity of every document under a model of the trusted ones, and whether it is kept."""
from .common import table
from .kneser_ney import classify


def op3_kneser_ney(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
