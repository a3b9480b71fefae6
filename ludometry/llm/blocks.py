"""Documents in blocks, and packed sets of hashes sent between blocks through buckets.

A block is a row with some documents, a few megabytes of text. Passes over the
corpus read the blocks; what a pass finds in one block travels as packed arrays
of hashes, cut into buckets by hash value. A hash leaves a block once however
often it occurs there, so a passage in a third of all documents costs one entry
per block, and a bucket holds its share of the hashes. Blocks are a table
bucketed by block id, so answers join them without moving the texts again.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ludometry.session import checkpoint_dir

from .arrow_batches import slices

#: Names of the block tables of this session, in the order they were written.
TABLES: list[str] = []
MESSAGE = "bucket int, block long, hashes binary, many binary"
REPLY = "block long, hashes binary, often binary"
#: A row's id is its block id and, in the lowest bits, its place in the block.
TURN_BITS, PLACE_BITS = 27, 17


@dataclass
class Blocks:
    table: DataFrame  #: ``block long, rows array<struct<the documents' columns>>``
    schema: T.StructType  #: of the documents
    n_bytes: int
    n_buckets: int  #: for messages

    def join(self, answers: DataFrame) -> DataFrame:
        """The blocks with their answers: ``answers`` has ``block`` and one row per block at most."""
        return self.table.join(answers.hint("shuffle_hash"), "block", "left")


def pack(docs: DataFrame, text: str = "text", block_bytes: int = 2 << 20, bucket_bytes: int = 4 << 20) -> Blocks:
    """Write ``docs`` as blocks of about ``block_bytes`` of text; a longer text is a block of its own.

    The table lies in the shared checkpoint folder. Block ids are fixed there,
    so a task that runs again reads what it read before. Buckets grow with the
    corpus: one for ``bucket_bytes`` of text, four to a shuffle partition at least.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(docs.schema)), T.StructField("n_bytes", T.LongType())])
    row_type = pa.struct(list(to_arrow_schema(docs.schema)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << TURN_BITS
        for turn, part in enumerate(_gathered(slices(batches, text, block_bytes), text, block_bytes)):
            structs = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], fields=list(row_type))
            lists = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
            n_bytes = pa.compute.sum(pa.compute.binary_length(part.column(text))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([first + turn], pa.int64()), lists, pa.array([n_bytes], pa.int64())], names=["block", "rows", "n_bytes"])

    name = f"{_database(spark)}.blocks_{uuid.uuid4().hex}"
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs.mapInArrow(packed, schema).write.format("parquet").option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    TABLES.append(name)
    table = spark.table(name)
    n_bytes = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return Blocks(table.select("block", "rows"), docs.schema, n_bytes, max(4 * n, -(-n_bytes // bucket_bytes)))


def _database(spark: SparkSession) -> str:
    """A database whose tables lie in the shared checkpoint folder and go from there when they are dropped."""
    folder = os.path.join(checkpoint_dir(spark), "blocks")
    name = f"blocks_{hashlib.md5(folder.encode()).hexdigest()[:12]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}'")
    return name


def drop(spark: SparkSession, tables: Sequence[str]) -> None:
    """Remove block tables whose results have been written."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if name in TABLES:
            TABLES.remove(name)


def _gathered(parts: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = n = 0
    for part in parts:
        own = pa.compute.sum(pa.compute.binary_length(part.column(part.schema.get_field_index(text)))).as_py() or 0
        if held and (size + own > most or n + part.num_rows > 1 << PLACE_BITS):
            yield pa.Table.from_batches(held)
            held, size, n = [], 0, 0
        held.append(part)
        size += own
        n += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def rows_of(batch: pa.RecordBatch, at: int) -> pa.StructArray:
    """The documents of one block."""
    lists = batch.column(batch.schema.get_field_index("rows"))
    start, end = lists.offsets[at].as_py(), lists.offsets[at + 1].as_py()
    return lists.values.slice(start, end - start)


def texts_of(rows: pa.StructArray, text: str) -> pa.Array:
    """A field of the documents as an array of its own."""
    return rows.field(rows.type.get_field_index(text))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray, dict]]:
    """``(block, documents, the other columns)`` of every row."""
    for batch in batches:
        others = [n for n in batch.schema.names if n not in ("block", "rows")]
        for at in range(batch.num_rows):
            block = batch.column(batch.schema.get_field_index("block"))[at].as_py()
            yield block, rows_of(batch, at), {n: batch.column(batch.schema.get_field_index(n))[at].as_py() for n in others}


def with_results(rows: pa.StructArray, results: dict[str, pa.Array]) -> pa.RecordBatch:
    """The documents' columns and the results as a flat batch; results replace columns of their names."""
    names = [f.name for f in rows.type if f.name not in results]
    columns = [texts_of(rows, n) for n in names]
    return pa.RecordBatch.from_arrays([*columns, *results.values()], names=[*names, *results])


def result_schema(docs: T.StructType, results: str) -> T.StructType:
    own = T._parse_datatype_string(results)
    return T.StructType([*(f for f in docs if f.name not in own.fieldNames()), *own])


def messages(blocks: DataFrame, n_buckets: int, hashes: Callable[[pa.StructArray, dict], np.ndarray]) -> DataFrame:
    """For each block the distinct values of ``hashes(documents, other columns)``, cut into buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, others in each_block(batches):
            found, counts = np.unique(hashes(rows, others), return_counts=True)
            if len(found):
                yield _cut(block, found, counts > 1, n_buckets)

    return blocks.mapInArrow(send, MESSAGE)


def _cut(block: int, found: np.ndarray, many: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    bucket = bucket_of(found, n_buckets)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(found)]])
    spans = list(zip(edges, edges[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[edges[:-1]], pa.int32()),
            pa.array(np.full(len(spans), block), pa.int64()),
            pa.array([found[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([np.packbits(many[a:b]).tobytes() for a, b in spans], pa.binary()),
        ],
        names=["bucket", "block", "hashes", "many"],
    )


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Equal ranges of the 64-bit values; ascending with the hash."""
    return np.minimum((hashes >> np.uint64(11)).astype(np.float64) * (n_buckets / 2.0**53), n_buckets - 1).astype(np.int32)


def unpack(binary: bytes | None, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(binary, kind) if binary else np.zeros(0, kind)


def repeated(sent: DataFrame, often: int = 1 << 62) -> DataFrame:
    """``(block, hashes, often)``, one row per block that has any: its hashes that occur at least twice in the corpus.

    ``often`` are those of them that at least so many blocks hold.
    """

    def find(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in group["hashes"].to_pylist()]
        many = [np.unpackbits(unpack(x, np.uint8))[: len(p)] for x, p in zip(group["many"].to_pylist(), parts)]
        whole = np.concatenate(parts)
        order = np.argsort(whole)
        ordered = whole[order]
        twice = np.zeros(len(whole), bool)
        same = ordered[1:] == ordered[:-1]
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        twice |= np.concatenate(many).astype(bool)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.diff(np.concatenate([starts, [len(whole)]]))
        holders = np.empty(len(whole), np.int64)
        holders[order] = np.repeat(sizes, sizes)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        kept = [p[t] for p, t in zip(parts, np.split(twice, cuts))]
        hot = [p[t] for p, t in zip(parts, np.split(twice & (holders >= often), cuts))]
        some = [k for k, x in enumerate(kept) if len(x)]
        blocks = group["block"].to_numpy()
        columns = {n: pa.array([x[k].tobytes() for k in some], pa.binary()) for n, x in (("hashes", kept), ("often", hot))}
        return pa.table({"block": pa.array(blocks[some], pa.int64()), **columns})

    replies = sent.groupBy("bucket").applyInArrow(find, REPLY)
    return replies.groupBy("block").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("often").alias("often"))


def joined_hashes(lists: list[bytes] | None) -> np.ndarray:
    """The hashes of a block's replies, ascending."""
    return np.sort(np.concatenate([unpack(x) for x in lists])) if lists else np.zeros(0, np.uint64)


def contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values
