"""Source and sink round trips over tables derived from the given data."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import funnel as funnel_ops
from ..operators import segments
from ..session import checkpoint_dir
from ..sources import retail, tables
from .oracle_tables import PLAYERS, TXNS, UNITS
from .registry import query, tidy


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


@query(
    "csv_transactions",
    TXNS
    + """
 SELECT transaction_id, player_id, CAST(transaction_date AS VARCHAR) AS transaction_date, item_name, item_category,
  round(price_usd, 4) AS price_usd FROM transactions""",
)
def csv_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, read back with a declared schema."""
    path = _scratch(spark, "txns-csv")
    txns = retail.transactions(spark, sf_dir)
    names = ["transaction_id", "player_id", "transaction_date", "item_name", "item_category", "price_usd"]
    tables.write_table(txns.select(names), path, fmt="csv")
    schema = _fields(
        transaction_id=T.LongType(),
        player_id=T.LongType(),
        transaction_date=T.DateType(),
        item_name=T.StringType(),
        item_category=T.StringType(),
        price_usd=T.DoubleType(),
    )
    return tidy(tables.read_csv(spark, path, schema), 4)


@query("csv_units", UNITS + " SELECT userid, version, sum_gamerounds, retention_1, retention_7 FROM units")
def csv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "units-csv")
    schema = _fields(
        userid=T.LongType(),
        version=T.StringType(),
        sum_gamerounds=T.LongType(),
        retention_1=T.IntegerType(),
        retention_7=T.IntegerType(),
    )
    tables.write_table(retail.ab_units(spark, sf_dir).select(schema.names), path, fmt="csv")
    return tidy(tables.read_csv(spark, path, schema))


@query(
    "table_round_trip",
    TXNS
    + """
 SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, count(*) AS n, round(sum(price_usd), 4) AS revenue
 FROM transactions WHERE transaction_date >= DATE '2000-01-01' GROUP BY transaction_date""",
)
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table partitioned by year; the date filter prunes partitions."""
    path = _scratch(spark, "txns")
    txns = retail.transactions(spark, sf_dir).withColumn("year", F.year("transaction_date"))
    tables.write_table(txns.repartition(F.col("year"), F.pmod(F.xxhash64("transaction_id"), F.lit(8))), path, partition_by="year")
    back = tables.read_table(spark, path)
    recent = back.where((F.col("year") >= 2000) & (F.col("transaction_date") >= F.to_date(F.lit("2000-01-01"))))
    return tidy(
        recent.groupBy("transaction_date").agg(F.count("*").alias("n"), F.sum("price_usd").alias("revenue")), 4
    )


@query(
    "report_round_trip",
    PLAYERS
    + """
 SELECT 'tier_revenue' AS section, player_tier AS name, count(*) AS n, round(sum(total_spend_usd), 2) AS total FROM players
 GROUP BY player_tier
 UNION ALL SELECT 'crosstab', tutorial_completed || '/' || is_payer, count(*), NULL FROM players
 GROUP BY tutorial_completed, is_payer""",
)
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested JSON document written and read back."""
    path = _scratch(spark, "report")
    players = retail.players(spark, sf_dir)
    table = funnel_ops.crosstab(players, "tutorial_completed", "is_payer")
    sections = {"tier_revenue": segments.tier_revenue(players), "crosstab": table}
    tables.write_report(sections, path)
    doc = tables.read_report(spark, path)
    tiers = doc.select(F.inline("tier_revenue")).selectExpr("'tier_revenue' AS section", "player_tier AS name", "n_players AS n", "total_rev AS total")
    cells = doc.select(F.inline("crosstab")).selectExpr(
        "'crosstab' AS section", "concat(tutorial_completed, '/', is_payer) AS name", "n", "CAST(NULL AS DOUBLE) AS total"
    )
    return tidy(tiers.unionByName(cells), 2)
