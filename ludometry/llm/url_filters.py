"""URL filters: rules indexed by their rarest literal token.

A rule is either a host with a path prefix, which fits the host and all its
subdomains, or a text with ``*`` for any run of characters, looked for anywhere
in host and path. The tokens of a URL fetch candidate rules from the index, and
only those run their regular expressions. Rules without a whole token are
candidates of every URL, so the index never loses a match.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile("[a-z0-9]+")
_SCHEMA = "host_rule string, host_verdict string, pattern string, pattern_verdict string, n_candidates int"


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for ``host``, its subdomains, and paths that start with ``path`` (which starts with ``/``)."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def regex(self) -> re.Pattern:
        return re.compile(rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}")

    def tokens(self) -> set[str]:
        return _whole_tokens(f".{self.text}\0")


@dataclass(frozen=True)
class PatternRule:
    """``verdict`` where ``text`` occurs in host and path, A-Z like a-z; ``*`` stands for any characters."""

    text: str
    verdict: str

    def regex(self) -> re.Pattern:
        return re.compile("(?s).*?" + ".*?".join(map(re.escape, self.text.translate(_TO_LOWER).split("*"))))

    def tokens(self) -> set[str]:
        return set().union(*(_whole_tokens(f"\0{part}\0") for part in self.text.split("*")))


Rule = HostRule | PatternRule


def _whole_tokens(text: str) -> set[str]:
    """Tokens with literal characters other than token characters on both sides; ``\\0`` marks an open end."""
    low = text.translate(_TO_LOWER)
    return {m[0] for m in _TOKEN.finditer(low) if "\0" not in (low[m.start() - 1], low[m.end()])}


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", block_rules: int = 50_000) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, pattern, n_candidates``, one row per row.

    The longest fitting host rule decides; without one the longest fitting
    pattern (column ``pattern``), else ``default``. Equal lengths go to the
    smaller text. A URL that is null or has no ``://`` has empty host and path
    and gets ``default`` unless a pattern without tokens fits. Columns of
    ``pages`` with the result's names are replaced. Token counts cover all
    rows. Rules travel in blocks of ``block_rules``, one pass over the URL
    column for each, so what a task holds is bounded however long the list is.
    """
    base = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    out = base
    blocks = [list(rules)[i : i + block_rules] for i in range(0, len(rules), block_rules)]
    names = [f"__judged{i}" for i in range(len(blocks))]
    for name, block in zip(names, blocks):
        out = out.withColumn(name, _judge(block, _token_counts(base, block))("host", "path"))

    def best(kind: str) -> Column:
        found = [F.struct(F.length(f"{n}.{kind}").alias("l"), F.col(f"{n}.{kind}").alias("t"), F.col(f"{n}.{v}").alias("v")) for n in names for v in [f"{kind.removesuffix('_rule')}_verdict"]]
        return F.get(F.array_sort(F.filter(F.array(*found), lambda x: x.t.isNotNull()), _longest), 0)

    if not blocks:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "pattern": F.lit(None).cast("string"), "n_candidates": F.lit(0)})
    hit, other = best("host_rule"), best("pattern")
    total = sum((F.col(f"{n}.n_candidates") for n in names[1:]), F.col(f"{names[0]}.n_candidates"))
    return out.withColumns(
        {"rule": hit.t, "verdict": F.coalesce(hit.v, other.v, F.lit(default)), "pattern": F.when(hit.t.isNull(), other.t), "n_candidates": total}
    ).drop(*names)


def _longest(a: Column, b: Column) -> Column:
    return F.when(a.l != b.l, F.signum(b.l - a.l).cast("int")).when(a.t < b.t, -1).when(a.t > b.t, 1).otherwise(0)


def _token_counts(base: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each token of the rules; at most one row per such token reaches the driver."""
    wanted = sorted(set().union(*(r.tokens() for r in rules)))
    if not wanted:
        return {}
    tokens = F.array_distinct(F.split(F.translate(F.concat("host", "path"), _UPPER, _LOWER), "[^a-z0-9]+"))
    own = base.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    seen = base.select(F.explode(tokens).alias("token")).join(F.broadcast(own), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in seen.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Token → rules: each rule under its rarest whole token (ties: the smaller), or under ``""``."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def _judge(rules: Sequence[Rule], counts: dict[str, int]):
    index = build_index(rules, counts)

    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        compiled: dict[Rule, re.Pattern] = {}
        rows = []
        for h, p in zip(hosts, paths):
            subject = h + p
            low = subject.translate(_TO_LOWER)
            candidates = [r for t in {"", *_TOKEN.findall(low)} for r in index.get(t, ())]
            fits: dict[type, Rule] = {}
            for rule in candidates:
                pattern = compiled.get(rule) or compiled.setdefault(rule, rule.regex())
                kind = type(rule)
                if pattern.match(subject if kind is HostRule else low):
                    fits[kind] = min((rule, fits.get(kind, rule)), key=lambda r: (-len(r.text), r.text))
            hit, other = fits.get(HostRule), fits.get(PatternRule)
            rows.append((hit and hit.text, hit and hit.verdict, other and other.text, other and other.verdict, len(candidates)))
        return pd.DataFrame(rows, columns=["host_rule", "host_verdict", "pattern", "pattern_verdict", "n_candidates"])

    return F.pandas_udf(judge, _SCHEMA)
