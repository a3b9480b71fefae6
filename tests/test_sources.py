"""Readers, writers, reports and views."""

import datetime as dt

import pytest

from ludometry import session
from ludometry.sources import schemas, tables, views


def test_csv_dates_and_bad_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "transaction_id,player_id,transaction_date,item_name,item_category,price_usd,platform,country\n"
        "T1,P1,2024-05-01 00:00:00,gem,currency,0.99,iOS,US\n"
        "T2,P1,2024-05-02,gem,currency,,iOS,\n"
    )
    rows = tables.read_csv(spark, str(tmp_path / "t.csv"), schemas.TRANSACTIONS).orderBy("transaction_id").collect()
    assert [r["transaction_date"] for r in rows] == [dt.date(2024, 5, 1), dt.date(2024, 5, 2)]
    assert rows[1]["price_usd"] is None and rows[1]["country"] is None


def test_report_document(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    tables.write_report({"first": a, "second": a.limit(1)}, str(tmp_path / "r"))
    doc = tables.read_report(spark, str(tmp_path / "r")).first()
    assert sorted((r["k"], r["v"]) for r in doc["first"]) == [("x", 1), ("y", 2)]
    assert len(doc["second"]) == 1


def test_pretty_printed_report(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "best_k": 3,\n "scores": [\n  {"k": 2, "s": 0.2}\n ]\n}')
    doc = tables.read_report(spark, str(tmp_path / "d.json")).first()
    assert doc["best_k"] == 3 and doc["scores"][0]["k"] == 2


def test_partitioned_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    tables.write_table(df, str(tmp_path / "t"), partition_by="p")
    back = tables.read_table(spark, str(tmp_path / "t")).where("p = 'a'")
    assert [r["v"] for r in back.collect()] == [1]


def test_views_are_usable_from_sql(spark):
    players = spark.createDataFrame(
        [
            ("a", dt.date(2024, 1, 3), dt.date(2024, 2, 1), 1, 1, 0, 0, 1, 10.0, 3, 5, 2.0, 4, 7, "whale"),
            ("b", dt.date(2024, 1, 4), dt.date(2024, 2, 1), 0, 0, 0, 0, 0, 0.0, 0, 9, 4.0, 2, 3, "free_rider"),
        ],
        "player_id string, install_date date, last_active_date date, tutorial_completed int, d1_retained int, "
        "d7_retained int, d30_retained int, is_payer int, total_spend_usd double, num_purchases int, "
        "total_sessions int, avg_session_minutes double, days_active int, max_stage_reached int, player_tier string",
    )
    views.register_views(spark, players)
    day = spark.sql("SELECT * FROM vw_daily_kpis").first()
    assert (day["dau"], day["paying_dau"], day["daily_revenue"], day["avg_sessions"], day["avg_session_length"]) == (2, 1, 10.0, 7.0, 3.0)
    assert spark.sql("SELECT cohort_size, arppu, arpu FROM vw_cohort_retention").first() == (2, 10.0, 5.0)
    assert spark.sql("SELECT pct_players, pct_revenue FROM vw_whale_segments").first() == (100.0, 100.0)
    stages = {r["stage"]: r["players"] for r in spark.sql("SELECT * FROM vw_conversion_funnel").collect()}
    assert stages["install"] == 2 and stages["repeat_purchaser"] == 1


def test_distinct_players_are_counted_once(spark):
    """Two rows of one player on a day are one active player."""
    df = spark.createDataFrame(
        [("a", dt.date(2024, 2, 1), 1, 1.0, 2, 3.0), ("a", dt.date(2024, 2, 1), 0, 2.0, 4, 5.0)],
        "player_id string, last_active_date date, is_payer int, total_spend_usd double, total_sessions int, avg_session_minutes double",
    )
    row = views.daily_kpis(df).first()
    assert (row["dau"], row["paying_dau"], row["daily_revenue"], row["avg_sessions"]) == (1, 1, 3.0, 3.0)


def test_materialize_uses_the_configured_folder(spark):
    folder = session.checkpoint_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    df = session.materialize(spark.range(3))
    assert df.inputFiles()[0].startswith(f"file://{folder}")
