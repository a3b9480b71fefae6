"""URL filters and licence scans by hand-made cases."""

import pytest

from ludometry.llm.license_scan import scan_licenses, whole_texts
from ludometry.llm.url_filters import HostRule, PatternRule, build_index, filter_urls

RULES = [HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("org", "/fr", "allow"), PatternRule("/ads/*.gif", "block")]

CASES = [
    ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("http://A.EXAMPLE.net/EN/1", "a.example.net", "/EN/1", "net/", "block"),
    ("http://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://net?x=http://b.net/en/", "net", "", None, "allow"),
    ("http://a.org/france#x", "a.org", "/france", "org/fr", "allow"),
    ("http://a.org/x/ADS/b/c.GIF", "a.org", "/x/ADS/b/c.GIF", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.mark.parametrize("block_rules", [1, 50_000])
def test_url_cases(spark, block_rules):
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in filter_urls(pages.union(pages), RULES, block_rules=block_rules).collect()}
    assert filter_urls(pages.union(pages), RULES).count() == 2 * len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), CASES[i]


def test_rules_stand_under_their_rarest_token():
    index = build_index(RULES, {"example": 1, "net": 50, "en": 9, "org": 3, "ads": 0, "gif": 7})
    assert {t: [r.text for r in rules] for t, rules in index.items()} == {"net": ["net/"], "example": ["example.net/en/"], "org": ["org/fr"], "ads": ["/ads/*.gif"]}
    # An open end is no token: such a rule is a candidate everywhere.
    assert list(build_index([PatternRule("track", "block")], {})) == [""]


def test_urls_without_rows_or_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, RULES).count() == 0
    assert filter_urls(pages, []).columns == ["page_id", "url", "host", "path", "rule", "verdict", "pattern", "n_candidates"]


def test_licences_inherit_from_the_nearest_directory(spark):
    filler = "plain words about nothing in particular\n" * 30
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/c/COPYING.txt", filler + "Licensed under the Apache License, Version 2.0."),
        ("a/x.py", filler),
        ("a/b/y.py", filler),
        ("a/b/c/z.py", filler),
        ("a/b/c/z.py", filler),
        ("a/b/c/own.py", filler + "Licensed under CC BY-NC 4.0."),
        ("ab/q.py", filler),
        ("r.py", None),
        (None, ""),
    ]
    docs = spark.createDataFrame([(p, t, "clash", "clash", "clash") for p, t in rows], "path string, text string, licence string, near string, best string")
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows) and {(r.near, r.best) for r in got} == {("clash", "clash")}
    found = {r.path: (r.licence, r.via, r.licence_dir) for r in got}
    assert found == {
        "a/LICENSE": ("MIT", "own", None),
        "a/b/c/COPYING.txt": ("Apache-2.0", "own", None),
        "a/x.py": ("MIT", "inherited", "a"),
        "a/b/y.py": ("MIT", "inherited", "a"),
        "a/b/c/z.py": ("Apache-2.0", "inherited", "a/b/c"),
        "a/b/c/own.py": ("CC-BY-NC-4.0", "own", None),
        "ab/q.py": (None, None, None),
        "r.py": (None, None, None),
        "": (None, None, None),
    }
    assert scan_licenses(docs.limit(0)).count() == 0


def test_licences_inside_lines_over_lines_and_as_whole_texts(spark):
    filler = "plain words about nothing in particular\n" * 30
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    mit = dict(whole_texts())["MIT"]
    rows = [
        ("in/line.py", filler + "Notice about our small project and its many files for readers. Licensed under the Apache License, Version 2.0.\n" + filler),
        ("in/far.py", filler + "one two three four five six seven eight nine ten eleven twelve Released under the MIT License.\n"),
        ("over/lines.py", gpl + filler),
        ("over/mozilla.py", filler + "// This Source Code Form is subject to the\n// terms of the Mozilla Public\n// License, v. 2.0.\n" + filler),
        ("whole/LICENSE", mit.replace("Permission is hereby granted, free of charge, to any person obtaining a copy", "Permission is granted")),
        ("whole/x.py", filler),
        ("block/head.py", gpl),
        ("block/x.py", filler),
        ("none/x.py", filler),
    ]
    docs = spark.createDataFrame(rows, "path string, text string")
    found = {r.path: (r.licence, r.via, r.licence_dir) for r in scan_licenses(docs).collect()}
    assert found == {
        "in/line.py": ("Apache-2.0", "own", None),
        "in/far.py": ("MIT", "own", None),
        "over/lines.py": ("GPL-3.0", "own", None),
        "over/mozilla.py": ("MPL-2.0", "own", None),
        "whole/LICENSE": ("MIT", "own", None),
        "whole/x.py": ("MIT", "inherited", "whole"),
        "block/head.py": ("GPL-3.0", "own", None),
        "block/x.py": ("GPL-3.0", "inherited", "block"),
        "none/x.py": (None, None, None),
    }
