"""Query of operator 2: words each document gives to the mix of sources."""
from pyspark.sql import functions as F

from .common import table
from .mixing import taken


def op2_mix_sources(spark, sf_dir):
    out = taken(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"), "n_slots")


#: The points, the sources that they fall to, the rank of each slot in its source, and what the dealt blocks take of each document.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
   md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#mix#' || md5(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
 w AS (SELECT *, (k - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
 l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
   FROM w WINDOW f AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 z AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap > level * weight),
 t AS (SELECT source, k, source_size, round(least(cap::DOUBLE, coalesce(z.level * weight, cap::DOUBLE)), 6) AS target, (source_size + 63) // 64 AS b FROM w LEFT JOIN z ON true),
 g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * b + 0.5) AS BIGINT) ELSE 0 END AS slots FROM t),
 c AS (SELECT *, sum(slots) OVER (ORDER BY k) AS hi, sum(slots) OVER () AS total FROM g),
 q AS (SELECT t AS slot, ((t % 1048576) * 6.180339887498949e-1) % 1e0 + ((t // 1048576) * PHI20) % 1e0 AS p FROM range(0, (SELECT CAST(max(total) AS BIGINT) FROM c)) r(t)),
 m AS (SELECT k, b AS mb, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS r FROM q JOIN c
   ON slots > 0 AND p % 1e0 >= (hi - slots)::DOUBLE / total AND p % 1e0 < CASE WHEN hi = total THEN 2e0 ELSE hi::DOUBLE / total END),
 n AS (SELECT k, least(count(*), 3 * any_value(mb)) AS n FROM m GROUP BY k),
 p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS e FROM d),
 x AS (SELECT p.*, k, b, source_size, target, coalesce(n, 0) AS n, (e - size) // 64 AS b1, (e - 1) // 64 AS b2 FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN n USING (k))
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (n // b) + greatest(0, least(e, n % b * 64) - (e - size)) ELSE 0 END AS BIGINT) AS taken, slot AS first_slot,
  CAST(CASE WHEN size > 0 THEN (b2 - b1 + 1) * (n // b) + greatest(0, least(b2 + 1, n % b) - b1) ELSE 0 END AS BIGINT) AS n_slots
FROM x LEFT JOIN m ON m.k = x.k AND m.r = x.b1 AND m.r < 3 * m.mb AND x.size > 0
""".replace("PHI20", repr((0.6180339887498949 * (1 << 20)) % 1.0) + "::DOUBLE")
