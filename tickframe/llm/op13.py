"""Query of operator 13: the strongest collocations of each language."""
from .common import table
from .phrases import collocations


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM t),
 n AS (SELECT lang, CAST(sum(len(x)) AS BIGINT) AS n FROM w GROUP BY lang),
 p AS (SELECT lang, k, unnest(list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(x) >= k),
 f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM p GROUP BY lang, k, phrase HAVING count(*) >= 100),
 c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
 cut AS (SELECT lang, phrase, a, k, x, unnest(range(1, k)) AS i FROM c),
 s AS (SELECT cut.lang, cut.phrase, a, i, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cut JOIN n ON n.lang = cut.lang
   JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(x[1:i], ' ') AND l.k = i JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(x[i + 1:], ' ') AND r.k = cut.k - i),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
 sub AS (SELECT DISTINCT lang, a AS f, array_to_string(x[i:j], ' ') AS phrase FROM c, range(1, 6) r(i), range(1, 6) q(j) WHERE i < j AND j <= k AND j - i + 1 < k),
 o AS (SELECT m.* FROM m WHERE NOT EXISTS (FROM sub WHERE sub.lang = m.lang AND sub.phrase = m.phrase AND 100 * sub.f >= 100 * m.a)),
 z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM z WHERE rank <= 2000
"""
