"""All batch jobs end to end on the smallest tables."""

from pyspark.sql import functions as F

from ludometry.operators import liveops
from ludometry.plans import workflow
from ludometry.session import materialize
from ludometry.sources import retail, tables

SF = "/root/testdata/sf0.001"


def test_end_to_end(spark, tmp_path):
    out = str(tmp_path)
    players = materialize(retail.players(spark, SF))
    txns = materialize(retail.transactions(spark, SF))
    activity = retail.activity(spark, SF)
    master = workflow.build_features(players, txns, out, retail.OBS, retail.CATEGORIES, activity, ios="BUILDING")
    assert master.count() == players.count()

    segmented = workflow.segment_players(master, out, ks=(2, 3), restarts=1)
    doc = tables.read_report(spark, f"{out}/segmentation_results").first()
    assert {r["k"] for r in doc["kmeans"]} == {2, 3}
    assert sum(r["n_players"] for r in doc["tier_revenue"]) == segmented.count()
    assert segmented.where("is_payer = 0 AND dbscan_cluster <> -2").isEmpty()

    workflow.funnel_report(segmented, out, ["platform"], ["tutorial_completed", "d1_retained", "total_sessions"])
    doc = tables.read_report(spark, f"{out}/funnel_results").first()
    assert len(doc["funnel"]) == 8 and len(doc["friction_tests"]) == 3

    workflow.experiment_report(retail.ab_units(spark, SF), out)
    doc = tables.read_report(spark, f"{out}/ab_testing_results").first()
    assert len(doc["z_tests"]) == 2 and len(doc["power"]) == 8
    assert len(doc["mde"]) == 2 and len(doc["cuped"]) == 2 and len(doc["mean_difference"]) == 1

    workflow.ltv_report(segmented, txns, out, retail.OBS, ["total_sessions", "fb_connected"], trees=2)
    doc = tables.read_report(spark, f"{out}/ltv_results").first()
    assert tables.read_table(spark, f"{out}/kaplan_meier").count() > 8
    assert len(doc["ltv_7d"]) == 1 and 0 <= doc["concordance"][0]["concordance"] <= 1

    weekly = liveops.weekly_kpis(activity, F.col("event_type") == "purchase")
    scores = workflow.score_churn(segmented, out, trees=3, weekly=weekly)
    doc = tables.read_report(spark, f"{out}/churn_results").first()
    assert scores.count() == segmented.count()
    assert len(doc["recommendations"]) == 5 and len(doc["alerts"]) == 6
    assert len({r["player_id"] for r in doc["top_churners"]}) == 3
