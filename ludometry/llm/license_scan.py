"""Licence scans: lines against templates by sparse TF-IDF cosine, then inheritance down the directory tree.

DataFrame functions only. A line, or a run of tokens across line ends, is
compared with the templates where it holds an anchor of one: its heaviest
tokens, taken until the rest is too light to reach the threshold alone. So no
line or run at or above the threshold is missed, and the product touches shared
tokens only. Whole texts of files named as licences, or with an anchor, are
compared with licences in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludometry.session import materialize

#: Licence and a header or opening sentence of it.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
]
#: Headers that wrap over lines; only runs of tokens are compared with them.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([.].*)?$"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def weight(df: int, n: int) -> float:
    """A whole number, so that sums are the same in any order."""
    return math.floor(1000 * math.log((1 + n) / (1 + df)) + 0.5) + 1.0


def token_weights(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> tuple[dict[str, float], float]:
    """Weights of the templates' tokens by the documents that hold them, and that of any other token."""
    held = docs.select(F.array_intersect(_tokens(F.col(text)), F.split(F.lit(" ".join(vocabulary)), " ")).alias("held"))
    rows = held.select(F.explode(F.array_append(F.coalesce("held", F.array().cast("array<string>")), F.lit(""))).alias("t")).groupBy("t").count().collect()
    counts = {r["t"]: r["count"] for r in rows}
    n = counts.get("", 0)
    return {t: weight(counts.get(t, 0), n) for t in vocabulary}, weight(0, n)


def scan_licenses(docs: DataFrame, path: str = "path", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.25, headers: Sequence[tuple[str, str]] = HEADERS, texts: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` without its text plus ``licence, via, score, licence_dir``, one row per row.

    Compared are whole lines with ``templates``, runs of a template's number of
    tokens around its anchors, across line ends, with ``templates`` and
    ``headers``, and the whole text with ``texts`` (licences in full; None:
    those of ``licence_texts``). A file's own licence (``via`` = ``own``) is
    that of the highest cosine, at least ``threshold`` (ties: the smaller
    name); a match of the whole text goes before one of a part.
    A licence file is one named so, one whose whole text matches, or one whose
    matching lines and runs hold at least ``file_share`` of its words; it
    licenses its directory. Of several the highest cosine counts, then the
    smaller licence. Other files inherit the licence of the nearest directory
    above them (``via`` = ``inherited``), or get nulls. Null or empty texts
    have no line; a null path counts as an empty one; rows of one path are one
    file. Columns of ``docs`` named as the results are replaced. Token counts
    cover all documents; only those of the templates' tokens reach the driver.
    Lines weigh only the tokens of ``templates`` by their counts, runs and
    whole texts also those of ``headers`` and ``texts``.
    """
    texts = whole_texts() if texts is None else texts
    tf, runs_tf, whole_tf = ([_counted(body) for _, body in some] for some in (templates, [*templates, *headers], texts))
    vocabulary = sorted(set().union(*runs_tf, *whole_tf))
    known, other = token_weights(docs, vocabulary, text)
    weights = {t: known[t] for t in sorted(set().union(*tf))}
    line_gate = _gate(set().union(*(_anchors(c, weights, threshold) for c in tf)))
    near: dict[int, set[str]] = {}
    for c in runs_tf:
        near.setdefault(sum(c.values()), set()).update(_anchors(c, known, threshold))
    gate = _gate(set().union(*near.values(), *(_anchors(c, weights, threshold) for c in tf)))
    base = docs.withColumn(path, F.coalesce(F.col(path).cast("string"), F.lit("")))
    # Written, since parts and whole texts are both read from them: all texts meet the gate once.
    named = F.element_at(F.split(path, "/"), -1).rlike(FILE_NAMES)
    met = base.select(F.col(path).alias("__path"), F.col(text).alias("__text"), named.alias("__named"), F.coalesce(F.col(text).rlike(gate), F.lit(False)).alias("__met"))
    gated = materialize(met.where("__text IS NOT NULL AND (__named OR __met)").withColumn("__row", F.monotonically_increasing_id()))
    some = gated.where("__met").select("__path", "__row", F.split("__text", "\n").alias("__lines"))
    parts = some.select("__path", "__row", F.size(_tokens(F.array_join("__lines", "\n"))).alias("__words"), F.explode(F.concat(_whole_lines(F.col("__lines"), line_gate), _runs(F.col("__lines"), near))).alias("p"))
    # Written, since scores and places are both read from them: texts are cut into parts once.
    parts = materialize(parts.select("__path", "__row", "__words", F.col("p.line").alias("__line"), F.col("p.start").alias("start"), F.col("p.at").alias("at"), F.col("p.start").isNull().alias("__as_line")))
    distinct = materialize(parts.select("__line", "__as_line").distinct())
    scored = _best_template(distinct.where("__as_line").select("__line"), tf, [n for n, _ in templates], weights, other, threshold).withColumn("__as_line", F.lit(True)).unionByName(
        _best_template(distinct.where("NOT __as_line").select("__line"), runs_tf, [n for n, _ in [*templates, *headers]], known, other, threshold).withColumn("__as_line", F.lit(False))
    )
    match = F.struct("start", (-F.col("score")).alias("s"), F.col("licence").alias("l"), "n", "at")
    by_row = parts.join(scored, ["__line", "__as_line"]).groupBy("__path", "__row").agg(F.max("__words").alias("__words"), F.collect_list(match).alias("m"))
    part_own = (
        by_row.select("__path", "__words", F.array_min(F.transform("m", lambda x: F.struct(x.s, x.l))).alias("b"), _held(F.col("m")).alias("n"))
        .groupBy("__path")
        .agg(F.min("b").alias("best"), (F.sum("n") / F.max("__words")).alias("share"))
    )
    own = part_own.join(_whole(gated, whole_tf, [n for n, _ in texts], known, other, threshold), "__path", "full")
    own = materialize(own.select("__path", F.coalesce("whole.l", "best.l").alias("__own"), (-F.coalesce("whole.s", "best.s")).alias("__score"), F.when(F.col("whole").isNotNull(), 1.0).otherwise(F.col("share")).alias("share")))
    name = F.element_at(F.split("__path", "/"), -1)
    parent = F.regexp_replace("__path", "/?[^/]*$", "")
    licensed = own.where(name.rlike(FILE_NAMES) | (F.col("share") >= file_share)).groupBy(parent.alias("up")).agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("__own").alias("l"))).alias("b"))
    licensed = licensed.select("up", F.col("b.l").alias("dir_licence"), (-F.col("b.s")).alias("dir_score"))
    rows = base.drop(text, "licence", "via", "score", "licence_dir").withColumn("__path", F.col(path)).withColumn("__dir", parent)
    above = rows.select("__dir").distinct().withColumn("up", F.explode(_ancestors(F.col("__dir"))))
    nearest = above.join(licensed, "up").groupBy("__dir").agg(F.max(F.struct(F.length("up").alias("d"), F.col("up").alias("u"), F.col("dir_licence").alias("l"), F.col("dir_score").alias("s"))).alias("__near"))
    out = rows.join(own.drop("share"), "__path", "left").join(nearest, "__dir", "left")
    return out.withColumns(
        {
            "licence": F.coalesce("__own", "__near.l"),
            "via": F.when(F.col("__own").isNotNull(), "own").when(F.col("__near").isNotNull(), "inherited"),
            "score": F.coalesce("__score", "__near.s"),
            "licence_dir": F.when(F.col("__own").isNull(), F.col("__near.u")),
        }
    ).drop("__path", "__dir", "__own", "__score", "__near")


def _counted(body: str) -> Counter:
    return Counter(t for t in re.split("[^a-z0-9]+", body.lower()) if t)


def _gate(anchors: set[str]) -> str:
    return rf"(?i)(^|[^A-Za-z0-9])({'|'.join(sorted(anchors))})($|[^A-Za-z0-9])"


def whole_texts() -> list[tuple[str, str]]:
    """The licences in full that ``licence_texts`` holds; the driver reads them."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]


def _whole_lines(lines: Column, gate: str) -> Column:
    """Lines that hold an anchor, as ``array<struct<start, line, at>>`` with a null ``start``; ``at`` is the line's number."""
    numbered = F.transform(lines, lambda x, i: F.struct(F.lit(None).cast("int").alias("start"), x.alias("line"), F.array(i).alias("at")))
    return F.filter(numbered, lambda x: x.line.rlike(gate))


def _runs(lines: Column, near: dict[int, set[str]]) -> Column:
    """Runs of ``n`` tokens that hold one of ``near[n]``, as ``_whole_lines`` with the place of the first token; ``at`` are the lines of the tokens."""
    numbered = F.flatten(F.transform(lines, lambda x, i: F.transform(_tokens(x), lambda t: F.struct(t.alias("t"), i.alias("i")))))

    def of(tokens: Column, n: int, anchors: set[str]) -> Column:
        last = F.greatest(F.size(tokens) - n, F.lit(0))
        places = F.filter(F.transform(tokens, lambda u, p: F.when(u.t.isin(sorted(anchors)), p)), lambda p: p.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - n + 1, F.lit(0)), F.least(p, last)))))

        def run(s: Column) -> Column:
            part = F.slice(tokens, s + 1, n)
            return F.struct(s.alias("start"), F.array_join(F.transform(part, lambda u: u.t), " ").alias("line"), F.transform(part, lambda u: u.i).alias("at"))

        return F.transform(starts, run)

    # A transform of one element names the tokens, so that they are made once.
    return F.flatten(F.transform(F.array(numbered), lambda u: F.concat(*(of(u, n, a) for n, a in sorted(near.items())))))


def _held(matches: Column) -> Column:
    """Words of a row's matching lines, and of its matching runs outside of them; of overlapping runs the best, then the first."""
    is_line = lambda x: x.start.isNull()
    numbers = F.transform(F.filter(matches, is_line), lambda x: x.at[0])
    runs = F.array_sort(F.transform(F.filter(matches, lambda x: ~is_line(x)), lambda x: F.struct(x.start, x.s, x.n, F.size(F.filter(x.at, lambda i: ~F.array_contains(numbers, i))).cast("long").alias("rest"))))
    first = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("total"))

    def step(held: Column, x: Column) -> Column:
        end = x.start + x.n
        apart = F.struct(end.alias("end"), x.s.alias("s"), x.rest.alias("rest"), (held.total + held.rest).alias("total"))
        better = F.struct(end.alias("end"), x.s.alias("s"), x.rest.alias("rest"), held.total.alias("total"))
        return F.when(x.start >= held.end, apart).when(x.s < held.s, better).otherwise(held)

    lines = F.aggregate(F.filter(matches, is_line), F.lit(0).cast("long"), lambda a, x: a + x.n)
    return lines + F.aggregate(runs, first, step, lambda held: held.total + held.rest)


def _whole(gated: DataFrame, tf: Sequence[Counter], names: Sequence[str], weights: dict[str, float], other: float, threshold: float) -> DataFrame:
    """``(__path, whole)``: the licence in full that is nearest to a text, if it reaches the threshold."""
    texts = gated.select("__path", F.sha2("__text", 256).alias("__line"), _tokens(F.col("__text")).alias("__tokens"))
    counted = texts.select("__line", "__tokens").dropDuplicates(["__line"])
    best = _best_template(counted, tf, names, weights, other, threshold, F.col("__tokens"))
    return texts.select("__path", "__line").join(best, "__line").groupBy("__path").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("whole"))


def _ancestors(directory: Column) -> Column:
    """The directory itself and all above it, down to the empty root."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n))))


def _anchors(counts: Counter, weights: dict[str, float], threshold: float) -> set[str]:
    squares = sorted(((n * weights[t]) ** 2, t) for t, n in counts.items())
    rest, whole = 0.0, sum(s for s, _ in squares)
    light = set()
    for square, token in squares:
        rest += square
        if rest >= threshold**2 * whole * (1 - 1e-9):
            break
        light.add(token)
    return set(counts) - light


def _best_template(lines: DataFrame, tf: Sequence[Counter], names: Sequence[str], weights: dict[str, float], other: float, threshold: float, tokens: Column | None = None) -> DataFrame:
    """``(__line, licence, score, n)`` of the distinct lines that reach the threshold; ``n`` is a line's words, those of ``tokens`` if given."""
    spark = lines.sparkSession
    norms = [sum((n * weights[t]) ** 2 for t, n in c.items()) for c in tf]
    own = spark.createDataFrame([(t, k, names[k], n * weights[t] ** 2, norms[k]) for k, c in enumerate(tf) for t, n in c.items()], "t string, k int, licence string, w double, norm double")
    idf = spark.createDataFrame(list(weights.items()), "t string, idf double")
    counted = lines.select("__line", F.explode(_tokens(F.col("__line")) if tokens is None else tokens).alias("t")).groupBy("__line", "t").count()
    counted = materialize(counted).join(F.broadcast(idf), "t", "left")
    size = counted.groupBy("__line").agg(F.sum(F.pow(F.col("count") * F.coalesce("idf", F.lit(other)), 2)).alias("norm_line"), F.sum("count").alias("n"))
    dots = counted.where("idf IS NOT NULL").join(F.broadcast(own), "t").groupBy("__line", "k", "licence", "norm").agg(F.sum(F.col("count") * F.col("w")).alias("dot"))
    scored = dots.join(size, "__line").withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("norm_line")), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy("__line").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("b"), F.max("n").alias("n"))
    return best.select("__line", F.col("b.l").alias("licence"), (-F.col("b.s")).alias("score"), "n")
