"""Protocol invariants and determinism on the test tables."""

import pytest
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.operators import segments as SG
from ebbflow.operators import serving as SV
from ebbflow.plans.pipeline import Chain

from conftest import SF_MID, SF_SMALL


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    n = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert len(rows) == 7 and sum(r["n_customers"] for r in rows) == n


def test_thresholds_follow_the_rule_per_scale(spark):
    assert Chain(spark, SF_SMALL).thresholds == (0.5, 0.6)   # repair branch: High = Medium + 0.10
    assert Chain(spark, SF_MID).thresholds == (0.35, 0.4)


def test_tiers_segments_and_cells_partition_the_base(spark):
    ch = Chain(spark, SF_MID)
    acts = ch.customer_actions()
    n = acts.count()
    assert acts.groupBy("risk_tier").count().agg(F.sum("count")).first()[0] == n
    assert acts.groupBy("segment").count().agg(F.sum("count")).first()[0] == n
    m = SG.risk_value_matrix(ch.value_tiers()).collect()
    unknown = acts.where(F.col("value_tier") == C.VALUE_UNKNOWN).count()
    assert sum(r[f"n_{v}"] for r in m for v in C.TIER_ORDER) == n - unknown
    plan = SG.action_plan(acts).collect()
    assert [r["priority_group"] for r in sorted(plan, key=lambda r: r["priority_group_order"])] == C.GROUP_ORDER
    assert sum(r["n_customers"] for r in plan) == n


def test_calibrated_is_monotone_in_raw(spark):
    c = Chain(spark, SF_MID).calibrated()
    rows = c.groupBy("risk_score_full").agg(F.max("calibrated_probability").alias("mx"),
                                            F.min("calibrated_probability").alias("mn")).orderBy("risk_score_full").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["mx"] <= b["mn"] + 1e-12


def test_results_do_not_depend_on_partition_count(spark):
    import __spark_entry__ as E
    q = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q["action_plan"](spark, SF_MID).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = sorted(map(tuple, q["action_plan"](spark, SF_MID).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_search_customers_validation_cap_sort_and_purity(spark):
    lk = Chain(spark, SF_MID).lookup()
    with pytest.raises(SV.SearchError):
        SV.search_customers(lk, risk_tier="Extreme")
    with pytest.raises(SV.SearchError):
        SV.search_customers(lk, sort_by="tenure")
    total, rows = SV.search_customers(lk, risk_tier=["High", "Medium"], min_risk_score=0.3, limit=1000)
    got = rows.collect()
    assert len(got) == min(200, total)
    assert all(r["risk_tier"] in ("High", "Medium") and r["model_risk_score"] >= 0.3 for r in got)
    scores = [r["model_risk_score"] for r in got]
    assert scores == sorted(scores, reverse=True)


def test_lookup_unknown_key_and_no_history_customer(spark):
    lk = Chain(spark, SF_MID).lookup()
    assert lk.where(F.col("msno") == "C+999999/=").count() == 0
    no_hist = lk.where(F.col("total_transactions") == 0).collect()
    assert no_hist, "sf0.01 holds customers without history"
    r = no_hist[0]
    assert r["latest_is_auto_renew"] is None and r["cancel_rate"] is None and r["total_revenue"] is None
    assert r["value_tier"] == C.VALUE_UNKNOWN and r["risk_score_full"] == 0.5


def test_high_tier_default_label_is_relabelled(spark):
    lk = Chain(spark, SF_MID).lookup()
    bad = lk.where(F.col("risk_tier").isin("High", "Medium") & (F.col("segment") == C.STABLE_MONITOR)).count()
    assert bad == 0


def test_corrupted_stages_are_noticed(spark, chain_small):
    """Each check against a stored stage must fail on a damaged one."""
    from pyspark.sql import functions as F

    from ebbflow.operators import curves as CU
    from ebbflow.operators import quality as QU
    from ebbflow.operators import segments as SG
    from ebbflow.plans.q_misc import stage_predictions
    good = stage_predictions(chain_small)
    first = good.agg(F.min("msno")).first()[0]
    missing = good.where(F.col("msno") != first)
    assert QU.completeness(QU.attach_with_completeness(chain_small.dataset().select("msno"), missing, ["risk_tier"]), "risk_tier").first()["n_missing"] == 1
    flipped = good.withColumn("is_churn", F.when(F.col("msno") == first, 1 - F.col("is_churn")).otherwise(F.col("is_churn")))
    assert QU.aligned_lookup(chain_small.scored(), flipped).first()["n_label_mismatch"] == 1
    twice = good.unionByName(good.where(F.col("msno") == first))
    row = QU.aligned_lookup(chain_small.scored(), twice).first()
    assert (row["n_duplicate_keys"], row["n_holdout"], row["n_missing"]) == (1, 150, 0)
    label = chain_small.customer_actions().select("msno", F.col("priority_group").alias("label"))
    wrong = label.withColumn("label", F.when(F.col("msno") == first, F.lit("other")).otherwise(F.col("label")))
    assert QU.reconcile_labels(wrong, label).first()["n_mismatch"] == 1
    plan = SG.action_plan(chain_small.customer_actions())
    off = plan.withColumn("n_customers", F.col("n_customers") + 1)
    assert not any(r["equal"] for r in SG.segment_group_counts(off, chain_small.segments()).collect())
    assert all(r["equal"] for r in SG.segment_group_counts(plan, chain_small.segments()).collect())
    stored = CU.ranking_metrics(good, "risk_score_full").select(F.lit("pr_auc").alias("metric"), (F.col("pr_auc") + 0.01).alias("pr_auc"))
    now = CU.ranking_metrics(good, "risk_score_full").select(F.lit("pr_auc").alias("metric"), "pr_auc")
    assert not QU.reproduction_check(now, stored, "metric", "pr_auc", 1e-4).first()["ok"]
