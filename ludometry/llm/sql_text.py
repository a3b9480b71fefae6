"""Pieces of SQL for the oracles."""

from __future__ import annotations


def crc32_sql(name: str, source: str, ascii_only: bool = True) -> str:
    """Common table expressions that end in ``name (s, crc)``: the unsigned crc32 of each ``s`` of the query ``source``.

    ``s`` holds code points below U+0080, or with ``ascii_only=False`` below U+0100.
    """
    points = "list_transform(string_split(s, ''), lambda c: ord(c))"
    if not ascii_only:
        points = f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    eight = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"""
{name}_table AS (SELECT list({eight} ORDER BY i) AS t FROM (SELECT i::BIGINT AS i FROM range(256) r(i))),
{name}_bytes AS (SELECT s, list_transform({points}, lambda c: c::BIGINT) AS b FROM ({source})),
{name} AS (
  SELECT s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]))) AS crc
  FROM {name}_bytes, {name}_table)"""
