"""Exact top-k inner products: term-at-a-time accumulation over blocks.

Dimensions are the terms and candidates the documents. Each task holds one
group of candidates and one block of queries. The candidates' values are kept
per dimension as postings; each nonzero entry of a sparse query row scatters
its weighted postings into the query's dense score array. Partition selection
keeps the best of each group, and a merge over the groups gives the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOUND = "query_id long, vec_id long, score long"
#: Bytes of score arrays a task fills at once.
_SCORES = 16 << 20


def quantized(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component as double; null if the vector or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale)))))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, group_rows: int = 8192, block_queries: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query row, ties to the smaller id.

    ``queries`` is a condition on rows. Every row but those with the query's id
    is a candidate; equal rows count once, and rows whose vector is null, or
    has a null or non-finite component, take no part. Shorter vectors count as
    filled up with zeros. A query without candidates gives no row.

    Each of ceil(rows / ``group_rows``) groups of candidates meets each of
    ceil(queries / ``block_queries``) blocks of queries in one task, so memory
    is bounded however many there are of either.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("v"), queries.alias("q"))
    usable = usable.where("v IS NOT NULL AND vec_id IS NOT NULL").distinct()
    n, asked = usable.agg(F.count("*"), F.count_if("q")).first()
    groups, blocks = max(1, -(-n // group_rows)), max(1, -(-asked // block_queries))
    hashed = F.xxhash64("vec_id")
    rows = usable.withColumns({"g": F.pmod(hashed, F.lit(groups)).cast("int"), "b": F.pmod(F.xxhash64(hashed), F.lit(blocks)).cast("int")})
    candidates = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("g", "b", "vec_id", "v")
    asking = rows.where("q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("g", "b", "vec_id", "v")
    found = asking.groupBy("g", "b").cogroup(candidates.groupBy("g", "b")).applyInArrow(lambda a, c: _best_of_group(a, c, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, filled up with zeros."""
    ids = t["vec_id"].to_numpy()
    lists = t["v"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(ids)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = lists.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _width(t: pa.Table) -> int:
    return max((len(x) for x in t["v"]), default=0)


def _best_of_group(asking: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    if not asking.num_rows or not candidates.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    width = max(_width(asking), _width(candidates))
    query_ids, q = _matrix(asking, width)
    ids, c = _matrix(candidates, width)
    reach = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(width, 1)
    if reach >= 1 << 63:
        raise ArithmeticError("scores of these vectors do not fit a long")
    kind = np.int32 if reach < 1 << 31 else np.int64
    postings = np.ascontiguousarray(c.T.astype(kind))
    q = q.astype(kind)
    step = max(1, _SCORES // (8 * len(ids)))
    parts = [_select(query_ids[i : i + step], ids, _accumulate(q[i : i + step], postings), k) for i in range(0, len(q), step)]
    query_of, vec, score = (np.concatenate(x) for x in zip(*parts))
    return pa.table({"query_id": query_of, "vec_id": vec, "score": score.astype(np.int64)})


def _accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of each query with all candidates, one term of one query at a time."""
    scores = np.zeros((len(queries), postings.shape[1]), dtype=postings.dtype)
    weighted = np.empty(postings.shape[1], dtype=postings.dtype)
    for row, query in zip(scores, queries):
        for term in np.flatnonzero(query):
            np.multiply(postings[term], query[term], out=weighted)
            row += weighted
    return scores


def _select(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row of ``scores``; ``ids`` ascend, so ties keep the first places."""
    picked = [], [], []
    for query_id, row in zip(query_ids, scores):
        own = ids == query_id
        most = min(k + int(own.sum()), len(row))
        bound = np.partition(row, len(row) - most)[len(row) - most]
        above, level = np.flatnonzero((row > bound) & ~own), np.flatnonzero((row == bound) & ~own)
        places = np.concatenate([above, level[: max(0, k - len(above))]])
        for out, x in zip(picked, (np.full(len(places), query_id), ids[places], row[places])):
            out.append(x)
    return tuple(np.concatenate(x) for x in picked)
