"""Query of operator 12: log probability of every document under a trigram model of the training ones."""
from .common import table
from .lm_trie import score_texts


def op12_lm_scores(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
