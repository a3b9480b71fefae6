"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import TEMPLATES, scan_licenses
from .registry import query, table

_VALUES = ", ".join(f"({k}, '{name}', '{body}')" for k, (name, body) in enumerate(TEMPLATES))

SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' AS path, text FROM documents),
templates(k, licence, body) AS (VALUES {_VALUES}),
tf AS (
  SELECT k, licence, t, count(*) AS n
  FROM (SELECT k, licence, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS t FROM templates) WHERE t <> '' GROUP BY ALL),
total AS (SELECT count(*) AS n FROM docs),
held AS (
  SELECT DISTINCT doc_id, t FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM docs) SEMI JOIN tf USING (t)),
idf AS (
  SELECT t, floor(1000 * ln((1 + total.n) / (1.0 + coalesce(c, 0))) + 0.5) + 1 AS w
  FROM (SELECT DISTINCT t FROM tf) LEFT JOIN (SELECT t, count(*) AS c FROM held GROUP BY t) USING (t), total),
oov AS (SELECT floor(1000 * ln(1.0 + n) + 0.5) + 1 AS w FROM total),
norms AS (SELECT k, sum((n * w) ** 2) AS norm FROM tf JOIN idf USING (t) GROUP BY k),
lines AS (
  SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line,
    len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM docs),
counted AS (
  SELECT line, t, count(*) AS c
  FROM (SELECT line, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS t FROM (SELECT DISTINCT line FROM lines)) WHERE t <> '' GROUP BY ALL),
sizes AS (SELECT line, sum((c * coalesce(idf.w, oov.w)) ** 2) AS norm_line, sum(c) AS n FROM counted LEFT JOIN idf USING (t), oov GROUP BY line),
dots AS (SELECT line, k, licence, sum(c * tf.n * w * w) AS dot FROM counted JOIN tf USING (t) JOIN idf USING (t) GROUP BY ALL),
scored AS (
  SELECT line, licence, round(dot / sqrt(norm * norm_line), 6) AS score, n FROM dots JOIN sizes USING (line) JOIN norms USING (k)),
best AS (
  SELECT line, licence, score, n FROM scored WHERE score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, licence) = 1),
own AS (
  SELECT path, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score, sum(n) / max(words) AS share
  FROM lines JOIN best USING (line) GROUP BY path),
dirs AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, first(licence ORDER BY score DESC, licence) AS licence, max(score) AS score
  FROM own WHERE share >= 0.25 GROUP BY 1),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM docs),
near AS (
  SELECT p.dir, d.dir AS up, d.licence, d.score FROM (SELECT DISTINCT dir FROM placed) p
  JOIN dirs d ON p.dir = d.dir OR starts_with(p.dir, d.dir || '/') OR d.dir = ''
  QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(d.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.licence, near.licence) AS licence,
  CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' END AS via,
  coalesce(own.score, near.score) AS score, CASE WHEN own.licence IS NULL THEN near.up END AS licence_dir
FROM placed LEFT JOIN own USING (path) LEFT JOIN near USING (dir)
"""


@query("op9_license_scans", SQL)
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    placed = docs.select("doc_id", path.alias("path"), "text")
    return scan_licenses(placed).select("doc_id", "path", "licence", "via", "score", "licence_dir")
