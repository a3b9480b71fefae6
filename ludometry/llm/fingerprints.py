"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into tokens: runs of characters other than ASCII white space, at
most ``max_token`` code points each. Each run of ``k`` tokens has a hash, and
each window of ``w`` hashes selects its smallest, the rightmost on ties. So any
shared run of ``w + k - 1`` tokens shares a selected hash, and positions tell
where it lies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W, MAX_TOKEN = 3, 6, 16
_LAST = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the body's loops read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnow(text: Column, k: int = K, w: int = W, max_token: int = MAX_TOKEN) -> Column:
    """Selected ``hash << 32 | (2^31 - 1 - position)`` in order of position; hashes have 31 bits.

    Packed so, the smallest value of a window is its smallest hash at the
    rightmost place. Null and blank texts select nothing; a text of fewer than
    ``k`` tokens selects the hash of all of them, one of fewer than ``w`` runs
    the smallest of those.
    """

    def grams(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: _packed(F.xxhash64(*(F.get(h, i + j) for j in range(k))), i))
        short = F.array(_packed(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, short).otherwise(runs)

    def minima(g: Column) -> Column:
        slid = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - w + 1), lambda i: F.array_min(F.slice(g, i, F.lit(w)))))
        return F.when(F.size(g) == 0, g).when(F.size(g) <= w, F.array(F.array_min(g))).otherwise(slid)

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^ \t-\r]{{1,{max_token}}}"), F.lit(0))
    return let(let(F.transform(tokens, lambda t: F.xxhash64(t)), grams), minima)


def _packed(h: Column, position: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(_LAST).cast("long")), 32).bitwiseOR((F.lit(_LAST) - position).cast("long"))


def spelled(selected: Column) -> Column:
    """``hash@position`` of each selected hash, the hash in hexadecimal, joined by spaces."""
    return F.array_join(F.transform(selected, lambda s: F.concat(F.hex(F.shiftright(s, 32)), F.lit("@"), (F.lit(_LAST) - s.bitwiseAND(F.lit(_LAST).cast("long"))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the selected hashes without positions; 1 if neither has any."""

    def hashes(s: Column) -> Column:
        return F.transform(s, lambda x: F.shiftright(x, 32))

    def of(p: Column) -> Column:
        shared = F.size(F.array_intersect(p.x, p.y))
        either = F.size(F.array_union(p.x, p.y))
        return F.when(either == 0, 1.0).otherwise(shared / either)

    return let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), of)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", per_partition: int = 4) -> DataFrame:
    """``docs`` plus ``next_text`` and the fingerprints ``own`` and ``next`` of each row and the row after it by ``key``.

    After the last row comes the first. Rows are cut into ranges of about equal
    size at quantiles of the key, ``per_partition`` to a shuffle partition;
    each range also gets the first row of the next one, so no row of a range
    needs another. Repeated keys follow each other by text; a null key comes
    first. Texts are shuffled once.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    keyed = docs.withColumns({"__key": F.coalesce(F.col(key).cast("long"), F.lit(low)), text: F.coalesce(text, F.lit(""))})
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = keyed.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    ranged = keyed.withColumn("__range", _range_of(F.col("__key"), cuts))
    firsts = sorted((r["__range"], r["k"]) for r in ranged.groupBy("__range").agg(F.min("__key").alias("k")).collect())
    visits = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    guests = spark.createDataFrame(visits, "__key long, __guest int")
    placed = ranged.join(F.broadcast(guests), "__key", "left").withColumn("__at", F.explode(F.array_compact(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g")), F.when(F.col("__guest").isNotNull(), F.struct(F.col("__guest").alias("r"), F.lit(1).alias("g")))))))
    placed = placed.withColumns({"__r": F.col("__at.r"), "__g": F.col("__at.g")}).drop("__at", "__range", "__guest")
    own = placed.repartition("__r").withColumn("own", winnow(F.col(text)))
    order = Window.partitionBy("__r").orderBy("__g", "__key", text)
    led = own.withColumns({"next_text": F.lead(text).over(order), "next": F.lead("own").over(order)})
    return led.where("__g = 0").drop("__r", "__g", "__key")


def _range_of(key: Column, cuts: list[int], fan: int = 64) -> Column:
    """How many ``cuts`` lie below ``key``, by two short scans instead of one long one."""
    if not cuts:
        return F.lit(0)
    fan = max(fan, int(len(cuts) ** 0.5))
    all_cuts, heads = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[::fan]))
    below = F.size(F.filter(heads, lambda c: c < key))
    inner = F.slice(all_cuts, (F.greatest(below, F.lit(1)) - 1) * fan + 1, F.lit(fan))
    return F.when(below == 0, 0).otherwise((below - 1) * fan + F.size(F.filter(inner, lambda c: c < key))).cast("int")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of every text and of an edited one, one row per row of ``docs``.

    The edited text has its last ``floor(n_chars / share)`` code points replaced
    by the first as many (or all) of the next document. Columns: ``key``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (likeness to the edited text's and to the
    next document's). A null text counts as empty.
    """
    led = with_next(docs.select(key, text), key, text)
    n = F.length(text)
    tail = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))

    def judged(e: Column) -> Column:
        return let(
            winnow(e),
            lambda f: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), spelled(f).alias("fp"), likeness(F.col("own"), f).alias("near")),
        )

    out = led.withColumn("__e", let(edited, judged))
    return out.select(
        key,
        n.cast("long").alias("n_chars"),
        F.col("__e.sha").alias("edited_sha256"),
        spelled(F.col("own")).alias("fingerprint"),
        F.col("__e.fp").alias("edited_fingerprint"),
        F.col("__e.near").alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
