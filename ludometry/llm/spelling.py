"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated at every place. Turned so that
an edited character comes last, two words that differ only in that character
share everything before it; a word that lacks it is that prefix itself. So each
rotation without its last character is a key: sorted by key, the words of one
key are neighbours of each other, and no two other words are.

A key holds at most one word for each letter and one without, so groups are
bounded by the alphabet. Words travel as numbers in order of their counts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludometry.session import materialize

from .arrow_batches import slices

_RUNS = re.compile("[a-zÀ-ÿ]+")
_END = "$"
#: Longer keys travel as digests of both of their parts, so a word of any length makes rows of bounded size.
_LONG_KEY = 64
#: Distinct words a task counts before it passes them on.
_COUNTED = 200_000
_ROWS = 20_000
#: What a row is for its key: the word itself, or the word with the last character taken out.
_WHOLE, _CUT, _CUT_AGAIN = 0, 1, 2


def spelling_words(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_every: int = 97, least_points: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: the words of all texts with their counts.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, of which only
    A-Z are lower-cased. Where ``edit_every`` divides the crc32 h of
    ``<key>:<run>``, the run loses its code point ``h % length``. A null key
    counts as empty, a null text has no words; repeated rows count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches, "_text", 1 << 20):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                runs = Counter(_RUNS.findall((body or b"").lower().decode("utf-8", "replace")))
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    h = crc32(run.encode(), start)
                    if h % edit_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_points:
                        counts[run] += n
            if len(counts) >= _COUNTED:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each row of ``words`` (``word, n``, words distinct).

    Two words are near if one inserted, deleted or replaced code point makes
    one of the other. ``form`` is the near word of largest n (ties: smallest in
    code-point order) if that n is at least ``ratio`` times the word's own, else
    null; ``root`` is where a word's chain of forms ends, the word itself
    without one. Rows with a null word are left out, an empty word is near all
    words of one code point, an empty table gives no rows, other columns of
    ``words`` are left out.
    """
    named = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    by = [F.col("n").desc(), F.col("word")]
    # Partitions follow each other in order, so numbers ascend from the best word to the last.
    ranked = materialize(materialize(named).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()))
    near = _near(ranked)
    best = ranked.select(F.col("id").alias("best"), F.col("n").alias("best_n"), F.col("word").alias("best_word"))
    found = ranked.join(near, "id", "left").join(best, "best", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    found = materialize(
        found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(formed, F.col(a)).alias(b) for a, b in (("best", "up"), ("best_word", "form"), ("best_n", "form_n"))])
    )
    ends = _ends(found.where("up IS NOT NULL").select("id", "up"))
    roots = ranked.select(F.col("id").alias("end"), F.col("word").alias("end_word"))
    out = found.join(ends, "id", "left").join(roots, "end", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("end_word", "word").alias("root"))


def _near(ranked: DataFrame) -> DataFrame:
    """``id, n_near, best``: the number of near words and the first of them, for ids that have one.

    A run of equal letters can lose any of them to the same word: only the
    first counts there, so every pair counts once. Each replaced pair has one
    key only.
    """
    rotated = ranked.select("id", "word").mapInArrow(_rotate, "key binary, id long, role int")
    group = Window.partitionBy("key")
    order = group.orderBy("id")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)

    def holds(role: int):
        return F.count_if(F.col("role") == role).over(group)

    scanned = rotated.select(
        "id",
        "role",
        F.coalesce(F.first("id").over(ahead), F.lead("id").over(order)).alias("best"),
        F.count("*").over(group).alias("size"),
        holds(_WHOLE).alias("whole"),
        holds(_CUT).alias("cut"),
    ).where("size > 1")
    others = F.when(F.col("role") == _WHOLE, F.col("cut")).otherwise(F.col("size") - F.col("whole") - 1 + F.when(F.col("role") == _CUT, F.col("whole")).otherwise(0))
    return scanned.groupBy("id").agg(F.sum(others).alias("n_near"), F.min("best").alias("best"))


def _ends(ups: DataFrame) -> DataFrame:
    """``id, end``: where each chain ends. Counts grow along it, so it is short, and each round halves it."""
    chain = materialize(ups.withColumnRenamed("up", "end"))
    while True:
        further = chain.select(F.col("id").alias("end"), F.col("end").alias("next"))
        chain = materialize(chain.join(further, "end", "left").select("id", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved")))
        done = chain.where("moved").isEmpty()
        chain = chain.drop("moved")
        if done:
            return chain


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _keys(word: str) -> Iterator[tuple[bytes, int]]:
    """Key and role of every rotation of ``word``."""
    n = len(word)
    for i in range(n + 1):
        yield (word[i:] + _END + word[:i]).encode(), _WHOLE
    for i in range(n):
        yield (word[i + 1 :] + _END + word[:i]).encode(), _CUT_AGAIN if i and word[i] == word[i - 1] else _CUT


def _long_keys(word: str) -> Iterator[tuple[bytes, int]]:
    """As ``_keys``, in time linear in the word: 128-bit digests of the part before and the reversed part behind an edit."""
    n = len(word)
    heads, tails = _digests(word), _digests(word[::-1])
    for i in range(n + 1):
        yield (heads[i] + tails[n - i] if n >= _LONG_KEY else (word[i:] + _END + word[:i]).encode()), _WHOLE
    for i in range(n):
        yield heads[i] + tails[n - i - 1] if n > _LONG_KEY else (word[i + 1 :] + _END + word[:i]).encode(), _CUT_AGAIN if i and word[i] == word[i - 1] else _CUT


def _digests(word: str) -> list[bytes]:
    """A digest of each prefix, the empty one first."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for c in word:
        state.update(c.encode("utf-8", "surrogatepass"))
        out.append(state.copy().digest())
    return out


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[bytes] = []
    ids: list[int] = []
    roles: list[int] = []

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(roles, pa.int32())], names=["key", "id", "role"])
        keys.clear(), ids.clear(), roles.clear()
        return out

    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key, role in _keys(word) if len(word) < _LONG_KEY else _long_keys(word):
                keys.append(key)
                ids.append(number)
                roles.append(role)
                if len(keys) >= _ROWS:
                    yield rows()
    yield rows()
