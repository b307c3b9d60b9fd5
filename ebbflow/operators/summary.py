"""The nested risk-scoring summary document (scalars + thresholds struct +
array of tier rows) built as one row with ``struct`` / ``collect_list``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators import curves as CU
from ebbflow.operators import scoring as SC


def risk_summary_document(chain) -> DataFrame:
    s = chain.scored()
    medium, high = chain.thresholds
    y = F.col("is_churn").cast("double")
    scal = s.agg(F.count(F.lit(1)).alias("n_customers_scored"), F.avg(y).alias("actual_churn_rate"),
                 F.avg(F.pow(F.col("risk_score_full") - y, 2)).alias("brier_score_full"),
                 F.avg(F.pow(F.col("risk_score_proxy_controlled") - y, 2)).alias("brier_score_proxy_controlled")).first()
    aps = {r["c"]: r["pr_auc"] for r in
           [CU.ranking_metrics(s, c).select(F.lit(c).alias("c"), "pr_auc").first()
            for c in ["risk_score_full", "risk_score_proxy_controlled"]]}
    tiers = SC.risk_tier_table(s, medium, high)  # three rows
    return tiers.agg(F.sort_array(F.collect_list(F.struct(
        "tier_order", "tier", "score_range", "n_customers", "pct_of_base", "observed_churn_rate_in_tier"))).alias("risk_tiers")
    ).select(
        F.lit(scal["n_customers_scored"]).cast("bigint").alias("n_customers_scored"),
        F.lit(scal["actual_churn_rate"]).alias("actual_churn_rate"),
        F.lit(aps["risk_score_full"]).alias("pr_auc_full"),
        F.lit(aps["risk_score_proxy_controlled"]).alias("pr_auc_proxy_controlled"),
        F.lit(scal["brier_score_full"]).alias("brier_score_full"),
        F.lit(scal["brier_score_proxy_controlled"]).alias("brier_score_proxy_controlled"),
        F.struct(F.lit(high).alias("high_risk_threshold"), F.lit(medium).alias("medium_risk_threshold"))
        .alias("recommended_thresholds"),
        F.transform("risk_tiers", lambda t: t.dropFields("tier_order")).alias("risk_tiers"))


def flatten_risk_summary(doc: DataFrame) -> DataFrame:
    return doc.select("*", F.explode("risk_tiers").alias("t")).select(
        "n_customers_scored", "actual_churn_rate", "pr_auc_full", "pr_auc_proxy_controlled", "brier_score_full",
        "brier_score_proxy_controlled", "recommended_thresholds.*", "t.*")
