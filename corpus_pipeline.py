"""From raw documents to token ids: quality, near duplicates, repeated passages, source mix, encoding.

Every stage works on all rows that the stage before kept and returns the
columns of ``documents``; the last returns piece ids instead of texts. Between
stages rows are Parquet in the shared checkpoint folder, so a lost executor
costs the stage it ran, not the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludometry.llm import blocks
from ludometry.llm.mixing import in_mixed_order, mix_sources
from ludometry.llm.mixing_queries import WEIGHTS
from ludometry.llm.ngram_join import dedup_near
from ludometry.llm.piece_queries import MODEL
from ludometry.llm.pieces import encode_pieces
from ludometry.llm.quality import keep_quality
from ludometry.llm.registry import table
from ludometry.llm.suffix_dedup import dedup_bytes
from ludometry.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Block tables of the stages so far; a stage drops those of the ones before it, whose rows are written by then.
_spent: list[str] = []


def _packed(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """The result of a stage that packs its documents, after the tables of earlier stages are dropped."""
    _unpack(spark)
    known = set(blocks.TABLES)
    out = work()
    _spent.extend(name for name in blocks.TABLES if name not in known)
    return out


def _unpack(spark: SparkSession) -> None:
    blocks.drop(spark, _spent)
    _spent.clear()


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like any other."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; documents without words all stay."""
    return _packed(spark, lambda: dedup_near(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier too; a document may end up empty, none is dropped. A null text becomes an empty one."""
    kept = _packed(spark, lambda: dedup_bytes(docs, as_text=True)).withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the source mix; the files that are written follow it, ``encode`` states it in columns."""
    _unpack(spark)
    return in_mixed_order(mix_sources(docs, WEIGHTS)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with ``slot`` and ``position`` in the mix.

    Files read back in parts have no order, so places are worked out again:
    they depend on ``doc_id`` and ``source`` of all rows only. Sorting by
    ``position`` gives the mixed corpus.
    """
    placed = in_mixed_order(mix_sources(docs, WEIGHTS)).select(*docs.columns, "slot", "position")
    encoded = encode_pieces(placed, MODEL)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "slot", "position")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix),
    ("pieces", encode),
]

#: Learned weights, suffix order and piece ids are not SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
