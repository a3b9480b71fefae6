"""Query of the spelling variants, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .spelling import spelling_variants, spelling_words
from .sql_text import crc32_sql

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id::VARCHAR || ':' || translate(run, '{_UPPER}', '{_LOWER}') AS s, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
{crc32_sql("checked", "SELECT s FROM runs", ascii_only=False)},
edited AS (
  SELECT CASE WHEN crc % 97 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, n FROM runs JOIN checked USING (s)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS short FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS (
  SELECT a.word AS u, b.word AS v, b.n AS vn FROM cuts a JOIN cuts b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.short
  UNION
  SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.short),
near AS (SELECT u, count(DISTINCT v) AS n_near, max(vn) AS top FROM pairs GROUP BY u),
best AS (SELECT u, min(v) AS best, any_value(top) AS top FROM pairs JOIN near USING (u) WHERE vn = top GROUP BY u),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * n THEN best END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words LEFT JOIN (SELECT u, n_near, best, b.top FROM near JOIN best b USING (u)) ON u = word),
chain AS (
  SELECT word, word AS last_word, form FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT word, n, n_near, formed.form, form_n, last_word AS root FROM formed JOIN chain c USING (word) WHERE c.form IS NULL
"""


@query("op12_spelling_variants", SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spelling_words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
