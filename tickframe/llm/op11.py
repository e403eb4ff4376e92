"""Query of operator 11: a Merkle manifest of all documents, with the hash of every proof and the root that tampered documents fold to."""
from .common import table
from .merkle import manifest


def op11_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


#: crc32 of the decimal id, bit by bit (the generator is a fixed value of crc32).
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ord(c) AS BIGINT)),
   lambda a, c: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, c)), 4294967295))"""
_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "TEXT")) + ")"


def _tree(name: str, leaves: str, by: str) -> str:
    """All nodes of a forest, level by level; n is the number of nodes of the level."""
    return f"""{name}(lang, lev, p, h, n) AS (SELECT {by}, 0, p, h, count(*) OVER (PARTITION BY {by}) FROM {leaves} UNION ALL
   SELECT lang, lev + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY lang, lev, p // 8, n)"""


SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.replace('TEXT', 'text')} AS h,
   {_LEAF.replace('TEXT', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, {_CRC} % 3 = 0 AS hit FROM documents),
 f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p, row_number() OVER () AS id FROM d),
 {_tree('a', 'f', 'lang')},
 s AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM a WHERE n = 1),
 {_tree('b', 's', 'NULL')},
 run AS MATERIALIZED (SELECT 0 AS t, lang, lev, p // 8 AS r, list(h ORDER BY p) AS l FROM a WHERE n > 1 GROUP BY ALL
   UNION ALL SELECT 1, NULL, lev, p // 8, list(h ORDER BY p) FROM b WHERE n > 1 GROUP BY lev, p // 8),
 way AS (SELECT id, t, lev, l, CAST((f.p // (8 ** lev)::BIGINT) % 8 AS BIGINT) AS i FROM f JOIN run ON t = 0 AND f.lang IS NOT DISTINCT FROM run.lang AND r = f.p // (8 ** (lev + 1))::BIGINT
   UNION ALL SELECT id, t, lev, l, CAST((s.p // (8 ** lev)::BIGINT) % 8 AS BIGINT) FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang JOIN run ON t = 1 AND r = s.p // (8 ** (lev + 1))::BIGINT),
 step AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY t, lev) AS k, array_to_string(l[1:i], '') AS x, array_to_string(l[i + 2:], '') AS y FROM way),
 proof AS (SELECT id, sha256(string_agg(x || y, '' ORDER BY k)) AS proof FROM step GROUP BY id),
 fold(id, k, h) AS (SELECT id, 0, CASE WHEN hit THEN low ELSE h END FROM f UNION ALL SELECT fold.id, fold.k + 1, sha256(x || h || y) FROM fold JOIN step ON step.id = fold.id AND step.k = fold.k + 1),
 last AS (SELECT id, arg_max(h, k) AS h FROM fold GROUP BY id),
 root AS (SELECT h AS root FROM b WHERE n = 1)
SELECT doc_id, f.h AS leaf, s.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = root AS verified
FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang JOIN last USING (id) LEFT JOIN proof USING (id), root
"""
