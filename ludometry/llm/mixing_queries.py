"""Query of the source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_sources
from .registry import query, table

#: Target weights of the query; other sources have 1.
WEIGHTS = {"src0": 3, "src1": 2, "src2": 2}

SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
sources AS (
  SELECT source, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS w
  FROM (SELECT DISTINCT source FROM docs)),
total AS (SELECT sum(w)::BIGINT AS p FROM sources),
turns AS (
  SELECT source, turn, turn * p // w AS r, ((turn + 1) * p + w - 1) // w AS d FROM (SELECT source, w, unnest(range(w)) AS turn FROM sources), total),
every AS (SELECT list({'d': d, 'source': source, 'turn': turn, 'r': r}) AS all_turns FROM turns),
run(slot, done, pick) AS (
  SELECT -1::BIGINT, []::STRUCT(d BIGINT, source VARCHAR, turn BIGINT, r BIGINT)[], NULL::STRUCT(d BIGINT, source VARCHAR, turn BIGINT, r BIGINT)
  UNION ALL
  SELECT slot + 1, list_append(done, chosen), chosen FROM (
    SELECT slot, done, list_min(list_filter(all_turns, lambda x: x.r <= slot + 1 AND NOT list_contains(done, x))) AS chosen
    FROM run, every, total WHERE slot + 1 < p)),
schedule AS (SELECT pick.source AS source, pick.turn AS turn, pick.r AS r, pick.d AS d, slot AS s FROM run WHERE slot >= 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM docs),
placed AS (
  SELECT doc_id, source, rank // 32 AS block, rank % 32 AS place, rank // 32 % w AS turn, rank // 32 // w * p AS lap
  FROM ranked JOIN sources USING (source), total)
SELECT doc_id, source, block::BIGINT AS block, (lap + r)::BIGINT AS release, (lap + d)::BIGINT AS deadline, (lap + s)::BIGINT AS slot,
  ((lap + s) * 32 + place)::BIGINT AS position
FROM placed JOIN schedule USING (source, turn)
"""


@query("op2_mix_sources", SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, WEIGHTS)
