"""Query of the Merkle manifest, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merkle import fold_proof, leaf_digest, merkle_manifest
from .registry import query, table
from .sql_text import crc32_sql

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF = " || ".join(_field_sql(c) for c in FIELDS)
_TAMPERED = " || ".join(_field_sql("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)

SQL = f"""
WITH RECURSIVE {crc32_sql("checked", "SELECT DISTINCT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL")},
leaves AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256({_TAMPERED}) END AS tampered
  FROM documents LEFT JOIN checked ON s = doc_id::VARCHAR),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves),
up AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY tree, level, place // 2, n),
subroots AS (SELECT tree, digest FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, tree AS place, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM over WHERE n > 1 GROUP BY level, place // 2, n),
tops AS (SELECT tree, max(level) AS top FROM up GROUP BY tree),
fold AS (
  SELECT p.doc_id, p.leaf, p.tree, 0 AS level, p.place, coalesce(p.tampered, p.leaf) AS folded, '' AS proof, false AS above,
    row_number() OVER () AS rid FROM placed p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, CASE WHEN NOT f.above AND f.level = t.top THEN 0 ELSE f.level + 1 END,
    CASE WHEN NOT f.above AND f.level = t.top THEN f.tree ELSE f.place // 2 END,
    CASE WHEN NOT f.above AND f.level = t.top THEN f.folded
      WHEN f.place % 2 = 1 THEN sha256(coalesce(u.digest, o.digest) || f.folded) ELSE sha256(f.folded || coalesce(u.digest, o.digest, '')) END,
    f.proof || coalesce(u.digest, o.digest, ''), f.above OR f.level = t.top, f.rid
  FROM fold f JOIN tops t USING (tree)
  LEFT JOIN up u ON NOT f.above AND f.level < t.top AND u.tree = f.tree AND u.level = f.level AND u.place = xor(f.place, 1)
  LEFT JOIN over o ON f.above AND o.level = f.level AND o.place = xor(f.place, 1)
  WHERE NOT f.above OR f.level < (SELECT max(level) FROM over)),
last AS (SELECT * FROM fold WHERE above AND level = (SELECT max(level) FROM over))
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM last JOIN subroots s USING (tree), (SELECT digest FROM over WHERE n = 1) r
"""


@query("op13_merkle_manifest", SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = merkle_manifest(docs.withColumn("tampered", F.when(picked, leaf_digest(changed))), "doc_id", "lang", FIELDS, ["tampered"])
    siblings = F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), "")
    folded = manifest.withColumn("folded_root", fold_proof(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
