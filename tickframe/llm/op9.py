"""Query of operator 9: components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
from .common import table
from .jaccard import jaccard_components


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


#: SQL on whole tables: shingle lists joined over every shared shingle, then a recursive closure over the links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x20\x09-\x0D]+') AS x FROM documents),
 g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN []::VARCHAR[] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
   ELSE list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) END) AS s FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.k + y.k - o)),
 r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT r.doc_id, CAST(coalesce(any_value(n.k), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
