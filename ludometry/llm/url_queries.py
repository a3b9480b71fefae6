"""Query of the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .url_filters import HostRule, PatternRule, filter_urls

#: The rules of the query.
RULES = [
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
    PatternRule("spam-farm.", "block"),
    PatternRule("-casino.", "block"),
    PatternRule("/wp-login.", "block"),
    PatternRule("/adserver/", "block"),
    PatternRule("/track*/pixel.", "block"),
]

SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (
  SELECT *, '.' || host AS dotted, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE
    WHEN regexp_matches(low, '(?s)/track.*/pixel[.]') THEN '/track*/pixel.'
    WHEN contains(low, '/adserver/') THEN '/adserver/'
    WHEN contains(low, '/wp-login.') THEN '/wp-login.'
    WHEN contains(low, 'spam-farm.') THEN 'spam-farm.'
    WHEN contains(low, '-casino.') THEN '-casino.' END AS fitting
  FROM judged)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN fitting IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN fitting END AS pattern
FROM ruled
"""


@query("op1_url_filters", SQL)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")
