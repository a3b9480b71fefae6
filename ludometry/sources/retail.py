"""Order, line-item and event tables as players, transactions, activity and experiment units.

Definitions are in FIXTURES.md §2. A purchase is an urgent order, a session is
any order. Joins hang off ``orders`` as left joins to sides that are unique on
their key, so Catalyst drops a whole join when none of its columns is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segments import spend_tiers
from ..session import materialize

OBS = "2001-08-01"
CHURN_DAYS = 180
PRE_PERIOD_END = "1998-07-01"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _customer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and order date.

    Grouping by (customer, date) first spreads a very active customer over many
    tasks; what is left per customer is bounded by the calendar.
    """
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.count("*").alias("lines")
    )
    orders = load(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    pre = F.col("day") < F.to_date(F.lit(PRE_PERIOD_END))
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey", "day")
        .agg(
            F.count("*").alias("orders"),
            F.sum("qty").alias("qty"),
            F.sum("lines").alias("lines"),
            F.count(F.when(urgent, 1)).alias("purchases"),
            F.sum(F.when(urgent, F.col("o_totalprice"))).alias("spend"),
            F.sum(F.when(pre, F.col("o_totalprice"))).alias("pre_spend"),
            F.sum(F.when(~pre, F.col("o_totalprice"))).alias("post_spend"),
        )
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _customer_days(spark, sf_dir).withColumn(
        "install", F.min("day").over(Window.partitionBy("o_custkey"))
    )
    since = F.datediff("day", "install")
    return days.groupBy("o_custkey").agg(
        F.min("day").alias("install_date"),
        F.max("day").alias("last_active_date"),
        F.sum("orders").alias("total_sessions"),
        F.count("*").alias("days_active"),
        F.sum("qty").alias("qty"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("max_stage_reached"),
        F.max(since.between(1, 90).cast("int")).alias("d1_retained"),
        F.max(since.between(1, 365).cast("int")).alias("d7_retained"),
        F.max(since.between(1, 730).cast("int")).alias("d30_retained"),
        F.sum("purchases").alias("num_purchases"),
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("total_spend_usd"),
        F.min(F.when(F.col("purchases") > 0, F.col("day"))).alias("first_purchase"),
        F.coalesce(F.sum("pre_spend"), F.lit(0.0)).alias("pre_spend"),
        F.coalesce(F.sum("post_spend"), F.lit(0.0)).alias("post_spend"),
    )


def players_untiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with at least one order; no ``player_tier``."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = load(spark, sf_dir, "customer")
    minutes = F.coalesce(F.try_divide(F.col("qty"), F.col("max_stage_reached")), F.lit(0.0))
    return (
        _customers(spark, sf_dir)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("player_id"),
            "install_date",
            "last_active_date",
            F.col("c_mktsegment").alias("platform"),
            F.col("n_name").alias("country"),
            (F.col("c_acctbal") > 5000).cast("int").alias("fb_connected"),
            (F.col("c_acctbal") > 0).cast("int").alias("tutorial_completed"),
            "total_sessions",
            minutes.alias("avg_session_minutes"),
            (F.col("total_sessions") * minutes / 60).alias("total_play_hours"),
            "days_active",
            "max_stage_reached",
            "d1_retained",
            "d7_retained",
            "d30_retained",
            (F.col("num_purchases") > 0).cast("int").alias("is_payer"),
            "total_spend_usd",
            "num_purchases",
            F.datediff("first_purchase", "install_date").alias("days_to_first_purchase"),
            (F.datediff(F.to_date(F.lit(OBS)), "last_active_date") >= CHURN_DAYS).cast("int").alias("churned_d7"),
        )
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With tiers; written once, since the tier cuts and the caller both read it."""
    return spend_tiers(materialize(players_untiered(spark, sf_dir)))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of urgent orders."""
    lines = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            F.col("o_custkey").alias("player_id"),
            F.to_date("o_orderdate").alias("transaction_date"),
            F.col("p_name").alias("item_name"),
            F.col("p_brand").alias("item_category"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price_usd"),
        )
    )


CATEGORIES = [f"Brand#{i}" for i in range(1, 26)]


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("player_id"), "ts", "event_type", "value"
    )


def ab_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers split by key parity, with pre- and post-period spend."""
    return _customers(spark, sf_dir).select(
        F.col("o_custkey").alias("userid"),
        F.when(F.col("o_custkey") % 2 == 0, "gate_30").otherwise("gate_40").alias("version"),
        F.col("total_sessions").alias("sum_gamerounds"),
        F.col("d1_retained").alias("retention_1"),
        F.col("d7_retained").alias("retention_7"),
        F.col("pre_spend").alias("pre_spend"),
        F.col("post_spend").alias("revenue"),
    )
