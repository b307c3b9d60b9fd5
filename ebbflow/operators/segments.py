"""Segments, value tiers, risk x value matrix and action plan (B15-B20, D12-D19,
D40, D45, E2, E3, F3, F7).

Every group-level output is one ``groupBy`` over the customer table (partial +
final aggregation, so a group holding a third of the base is combined map-side)
followed by work on a frame of at most a few dozen rows."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow import config as C
from ebbflow.functions.expr import (INTENSITY, intensity_of, priority_group, recommend_cell,
                                    segment_rule)


def _order_frame(spark, name: str, values: list[str]) -> DataFrame:
    return small_frame(spark, [(v, i + 1) for i, v in enumerate(values)], f"{name} string, {name}_order int")


def assign_segments(pred: DataFrame) -> DataFrame:
    """One segment per customer, first matching rule wins."""
    return pred.withColumn("segment", segment_rule("risk_tier"))


def customer_segments(pred: DataFrame) -> DataFrame:
    """The per-customer segment table: key, label, tier, segment, 8 behaviour columns."""
    return assign_segments(pred).select("msno", "is_churn", "risk_tier", "segment", *C.CHAR_COLS)


def _group_profile(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Means of the behaviour columns and churn, n and % of base per group."""
    spark = df.sparkSession
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.col("is_churn").cast("double")).alias("is_churn"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in C.CHAR_COLS])
    # at most len(order) rows: whole-frame window total is bounded
    out = (_order_frame(spark, key, order).join(agg, key, "left")
           .withColumn("pct_of_base", F.col("n_customers") / F.sum("n_customers").over(Window.partitionBy()) * 100.0))
    return out.select(key, f"{key}_order", F.coalesce("n_customers", F.lit(0)).cast("bigint").alias("n_customers"),
                      "pct_of_base", "is_churn", *C.CHAR_COLS)


def tier_profile(pred: DataFrame) -> DataFrame:
    return _group_profile(pred, "risk_tier", C.TIER_ORDER)


def segment_summary(seg: DataFrame) -> DataFrame:
    return _group_profile(seg, "segment", C.SEGMENT_ORDER)


def unmatched_at_risk(seg: DataFrame) -> DataFrame:
    """Elevated-risk customers left in the default bucket, count and share."""
    at_risk = F.col("risk_tier").isin(*C.ELEVATED_TIERS)
    return seg.agg(
        F.count_if(at_risk & (F.col("segment") == C.STABLE_MONITOR)).alias("n_unmatched"),
        F.count_if(at_risk).alias("n_at_risk"),
    ).select("n_unmatched", "n_at_risk",
             (F.col("n_unmatched") / F.nullif(F.col("n_at_risk"), F.lit(0)) * 100.0).alias("pct_of_at_risk"))


def monthly_revenue_rate(df: DataFrame) -> DataFrame:
    """Total revenue over tenure months, floored at one month."""
    tenure = F.col("tenure_days_at_cutoff")  # greatest() skips nulls: a missing tenure must stay missing
    months = F.when(tenure.isNotNull(), F.greatest(tenure / F.lit(C.MONTH_DAYS), F.lit(1.0)))
    return df.withColumn("monthly_revenue_rate", F.col("total_revenue") / months)


def tercile_edges(scored: DataFrame) -> DataFrame:
    """E2 edges: linear-interpolated 1/3 and 2/3 quantiles of revenue among
    customers with transactions (one aggregate, one row)."""
    valued = scored.where(F.col("has_transactions_data") == 1)
    return RA.quantiles(valued, [], {"edge_low": ("total_revenue", 1 / 3), "edge_high": ("total_revenue", 2 / 3)})


def collect_tercile_edges(scored: DataFrame) -> tuple[float | None, float | None]:
    row = tercile_edges(scored).first()
    return row["edge_low"], row["edge_high"]


def assign_value_tiers(df: DataFrame, e1: float | None, e2: float | None) -> DataFrame:
    """Right-closed terciles (lowest included) for valued customers; the
    rest are 'Unknown (no transaction data)'.  Not ntile: ties stay together."""
    x = F.col("total_revenue")
    if e1 is None:
        tier = F.lit(C.VALUE_UNKNOWN)
    else:
        tier = (F.when(F.col("has_transactions_data") != 1, F.lit(C.VALUE_UNKNOWN))
                .when(x <= F.lit(e1), "Low").when(x <= F.lit(e2), "Medium").otherwise("High"))
    return df.withColumn("value_tier", tier)


def customer_value_tiers(vt: DataFrame) -> DataFrame:
    return vt.select("msno", "is_churn", "risk_tier", "segment", "total_revenue", "value_tier")


def customer_actions(vt: DataFrame) -> DataFrame:
    """B18-B20 per customer: recommendation, intensity and priority group."""
    rec = recommend_cell("risk_tier", "value_tier")
    return (vt.withColumn("recommendation", rec)
            .withColumn("intervention_intensity", intensity_of(F.col("recommendation")))
            .withColumn("priority_group", priority_group("risk_tier", "segment")))


def value_by_risk_tier(vt: DataFrame) -> DataFrame:
    """describe() of revenue per tier (customers with transactions only):
    count, mean, sample std, min, quartiles (linear), max, and the sum."""
    valued = vt.where(F.col("has_transactions_data") == 1)
    x = F.col("total_revenue").cast("double")
    agg = valued.groupBy("risk_tier").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.sum("total_revenue").cast("bigint").alias("total_HRR_sum"))
    out = RA.with_quantiles(agg, valued, ["risk_tier"], {"p25": (x, 0.25), "p50": (x, 0.5), "p75": (x, 0.75)})
    return out.select("risk_tier", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "total_HRR_sum")


def value_by_segment(vt: DataFrame) -> DataFrame:
    """Count, median, mean, sum of revenue by segment and share of the total."""
    valued = vt.where(F.col("has_transactions_data") == 1)
    agg = valued.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg(F.col("total_revenue").cast("double")).alias("mean_HRR"),
        F.sum("total_revenue").cast("bigint").alias("total_HRR"))
    agg = RA.with_quantiles(agg, valued, ["segment"], {"median_HRR": ("total_revenue", 0.5)}).select(
        "segment", "n_customers", "median_HRR", "mean_HRR", "total_HRR")
    # one row per segment (six): whole-frame window is bounded
    return agg.withColumn("pct_of_total_HRR",
                          F.col("total_HRR") / F.sum("total_HRR").over(Window.partitionBy()) * 100.0)


def risk_value_cells(vt: DataFrame) -> DataFrame:
    """D16/D17 long form: per (risk tier, value tier) cell the count, % of all
    customers (the unknown value tier counts in the denominator), churn rate and
    mean revenue."""
    agg = vt.groupBy("risk_tier", "value_tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_churn").cast("double")).alias("churn"),
        F.avg(F.col("total_revenue").cast("double")).alias("avg_hrr"))
    # one row per cell (<= 12): bounded whole-frame window
    return (agg.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100.0)
            .select("risk_tier", "value_tier", F.col("n").cast("bigint").alias("n"), "pct",
                    (F.col("churn") * 100.0).alias("churn_rate_pct"), "avg_hrr"))


def risk_value_matrix(vt: DataFrame) -> DataFrame:
    """C9 + D16 + D17: the wide matrix (one row per risk tier) from ONE pivot
    with a fixed value list, instead of joining five pivoted tables."""
    cells = risk_value_cells(vt).where(F.col("value_tier").isin(*C.TIER_ORDER))
    wide = cells.groupBy("risk_tier").pivot("value_tier", C.TIER_ORDER).agg(
        F.first("n").alias("n"), F.first("pct").alias("pct"), F.first("churn_rate_pct").alias("churn_rate_pct"),
        F.first("avg_hrr").alias("avg_hrr"))
    spark = vt.sparkSession
    out = _order_frame(spark, "risk_tier", C.TIER_ORDER).join(wide, "risk_tier", "left")
    cols = ["risk_tier", "risk_tier_order"]
    for metric in ["n", "pct", "churn_rate_pct", "avg_hrr"]:
        for v in C.TIER_ORDER:
            src = f"{v}_{metric}"
            c = F.coalesce(F.col(src), F.lit(0)).cast("bigint") if metric == "n" else F.col(src)
            cols.append(c.alias(f"{metric}_{v}"))
    for v in C.TIER_ORDER:
        cols.append(recommend_cell(F.col("risk_tier"), F.lit(v)).alias(f"recommendation_{v}"))
    return out.select(*cols)


def value_cells(vt: DataFrame) -> DataFrame:
    """Per risk x value cell (valued customers): n, % of base, churn,
    median and total revenue, auto-renew rate."""
    valued = vt.where(F.col("has_transactions_data") == 1)
    agg = valued.groupBy("risk_tier", "value_tier").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.col("is_churn").cast("double")).alias("churn"),
        F.sum("total_revenue").cast("bigint").alias("total_HRR"),
        F.avg(F.col("latest_is_auto_renew").cast("double")).alias("auto_renew"))
    agg = RA.with_quantiles(agg, valued, ["risk_tier", "value_tier"], {"median_HRR": ("total_revenue", 0.5)})
    n_all = vt.agg(F.count(F.lit(1)).alias("N")).first()["N"]  # one scalar
    return agg.select("risk_tier", "value_tier", "n_customers",
                      (F.col("n_customers") / F.lit(float(n_all)) * 100.0).alias("pct_of_base"),
                      (F.col("churn") * 100.0).alias("churn_rate_pct"), "median_HRR", "total_HRR",
                      (F.col("auto_renew") * 100.0).alias("auto_renew_rate_pct"))


# Per priority group (rule definition, defining characteristics, marketing objective).
# The five named-segment rule and characteristic sentences restate the segment rules above; the
# objective sentences and the two residual groups' texts are the original analysis' wording.
PLAN_TEXTS = {
    "At-Risk, Auto-Renew Off": (
        "risk_tier in {High, Medium} AND latest_is_auto_renew = 0",
        "Elevated risk with auto-renew switched off on the latest transaction.",
        "Direct auto-renew re-enable nudge + small incentive; lowest-cost, highest-leverage campaign."),
    "At-Risk Veteran": (
        "risk_tier in {High, Medium} AND tenure_days_at_cutoff >= 730 (first match after the rule above)",
        "Elevated risk after two or more years of tenure, auto-renew still on.",
        "Loyalty/appreciation-toned outreach, not a generic discount."),
    "At-Risk Newcomer": (
        "risk_tier in {High, Medium} AND tenure_days_at_cutoff < 180 (first match after the rules above)",
        "Elevated risk within the first six months of tenure.",
        "Onboarding-style engagement content; likely a habit-formation problem, not price."),
    "At-Risk, Price-Sensitive": (
        "risk_tier in {High, Medium} AND discount_rate > 0.05 (first match after the rules above)",
        "Elevated risk with a history of paying below list price.",
        "Pricing/plan-fit conversation or targeted discount."),
    "Unmatched At-Risk (no segment)": (
        "risk_tier in {High, Medium} AND none of the 5 segment rules matched",
        "No single defining behavioral trait; flagged at-risk by the model on signals other than auto-renew, tenure "
        "extremes, or discounting.",
        "Standard tier-based treatment per the risk-tier playbook; not one of the 5 named segments."),
    "Engaged Low-Risk (Champions)": (
        "risk_tier = Low AND total_transactions >= 20 AND latest_is_auto_renew = 1",
        "Low risk, heavy transaction history, auto-renew on.",
        "Advocacy/upsell: referrals, plan upgrades, early access -- not a retention play."),
    "Stable / Monitor": (
        "everyone else (default bucket) minus the unmatched at-risk residual above -- i.e. Low risk tier with no "
        "standout behavioral pattern",
        "Low risk tier; unremarkable auto-renew, tenure, and discount profile -- the majority baseline, not a "
        "distinguishing segment.",
        "No special campaign; low churn risk and no standout value signal to act on."),
}

# Rationale sentence of an action-plan row.
RATIONALE = ("{n} customers ({pct}% of base) with a {churn}% actual churn rate and {hrr} NT$ in Historical Realized "
             "Revenue among them (median {med} NT$/customer). {dom}% of this group falls into the '{rec}' cell of the "
             "risk x value framework, which sets the recommended intensity below.")


def plan_texts(spark) -> DataFrame:
    """The seven-row text dimension (joined by broadcast - fixed size)."""
    return small_frame(spark, [(k, *v) for k, v in PLAN_TEXTS.items()],
                                 "priority_group string, rule_definition string, defining_characteristics string, "
                                 "marketing_objective string")


def rationale(plan: DataFrame) -> Column:
    """The templated rationale of a plan row (Python-style number formatting)."""
    from ebbflow.functions.expr import py_fixed, py_grouped
    from ebbflow.operators.serving import _fill
    return _fill(RATIONALE, n=py_grouped(F.col("n_customers"), 0), pct=py_fixed(F.col("pct_of_base"), 2),
                 churn=py_fixed(F.col("churn_rate_pct"), 1), hrr=py_grouped(F.col("total_HRR"), 0),
                 med=py_grouped(F.col("median_HRR"), 0), dom=py_fixed(F.col("pct_matching_dominant_recommendation"), 0),
                 rec=F.col("dominant_risk_value_recommendation"))


def action_plan_full(actions: DataFrame) -> DataFrame:
    """D19 with the text columns and the templated rationale (13 columns)."""
    plan = action_plan(actions)
    return (plan.join(F.broadcast(plan_texts(actions.sparkSession)), "priority_group", "left")
            .select("priority_group", "priority_group_order", "rule_definition", "n_customers", "pct_of_base",
                    "churn_rate_pct", "total_HRR", "median_HRR", "defining_characteristics", "marketing_objective",
                    "intervention_intensity", "dominant_risk_value_recommendation",
                    "pct_matching_dominant_recommendation",
                    F.when(F.col("n_customers") > 0, rationale(plan)).alias("rationale")))


def action_plan(actions: DataFrame) -> DataFrame:
    """One row per priority group in fixed order: size, share, churn %, total
    and median revenue (unknown value tier excluded), the modal recommendation
    (ties -> smallest label), its share and intensity.  Rounded 2/2/2/2/1."""
    spark = actions.sparkSession
    valued = F.col("value_tier") != C.VALUE_UNKNOWN
    base = actions.groupBy("priority_group").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.col("is_churn").cast("double")).alias("churn"),
        F.sum(F.when(valued, F.col("total_revenue"))).cast("double").alias("total_HRR"))
    base = RA.with_quantiles(base, actions, ["priority_group"], {"median_HRR": (F.when(valued, F.col("total_revenue")), 0.5)})
    rec_counts = actions.groupBy("priority_group", "recommendation").agg(F.count(F.lit(1)).alias("k"))
    # (group, recommendation) pairs are at most 7 x 7 rows; ties -> smallest label
    w = Window.partitionBy("priority_group").orderBy(F.col("k").desc(), F.col("recommendation"))
    mode = (rec_counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("priority_group", F.col("recommendation").alias("dominant_risk_value_recommendation"),
                    F.col("k").alias("k_dominant")))
    plan = (_order_frame(spark, "priority_group", C.GROUP_ORDER)
            .join(base, "priority_group", "left").join(mode, "priority_group", "left"))
    n_total = F.sum("n_customers").over(Window.partitionBy())  # 7 rows
    return plan.select(
        "priority_group", "priority_group_order",
        F.coalesce("n_customers", F.lit(0)).cast("bigint").alias("n_customers"),
        F.round(F.coalesce(F.col("n_customers"), F.lit(0)) / n_total * 100.0, 2).alias("pct_of_base"),
        F.round(F.col("churn") * 100.0, 2).alias("churn_rate_pct"),
        F.round(F.coalesce(F.col("total_HRR"), F.lit(0.0)), 2).alias("total_HRR"),
        F.round("median_HRR", 2).alias("median_HRR"),
        intensity_of(F.col("dominant_risk_value_recommendation")).alias("intervention_intensity"),
        "dominant_risk_value_recommendation",
        F.round(F.col("k_dominant") / F.col("n_customers") * 100.0, 1).alias("pct_matching_dominant_recommendation"),
    )


def segment_group_counts(stored_plan: DataFrame, segments: DataFrame) -> DataFrame:
    """Size of each priority group recomputed from the per-customer labels
    (file label + B18 relabel) beside the stored action plan's count; must be equal."""
    relabeled = segments.groupBy(priority_group("risk_tier", "segment").alias("priority_group")).agg(
        F.count(F.lit(1)).alias("n_relabeled"))
    plan = stored_plan.where(F.col("n_customers") > 0).select("priority_group", F.col("n_customers").alias("n_plan"))
    return (plan.join(relabeled, "priority_group", "full")
            .select("priority_group", F.coalesce("n_plan", F.lit(0)).cast("bigint").alias("n_plan"),
                    F.coalesce("n_relabeled", F.lit(0)).cast("bigint").alias("n_relabeled"),
                    (F.coalesce("n_plan", F.lit(0)) == F.coalesce("n_relabeled", F.lit(0))).alias("equal")))


def priority_opportunities(plan: DataFrame, top_n: int | None = None) -> DataFrame:
    """Retention groups ranked by revenue (desc), 1..n.  ``plan`` has seven
    rows, so the ordering window is bounded."""
    opp = plan.where(~F.col("priority_group").isin(*C.NON_RETENTION_GROUPS))
    w = Window.orderBy(F.col("total_HRR").desc(), F.col("priority_group"))
    out = opp.withColumn("priority_rank", F.row_number().over(w))
    if top_n:
        out = out.where(F.col("priority_rank") <= top_n)
    return out.select("priority_rank", "priority_group", "n_customers", "total_HRR", "churn_rate_pct",
                      "intervention_intensity")


def playbook(plan: DataFrame) -> DataFrame:
    """all seven groups banded retain (revenue desc) -> grow -> monitor."""
    band = (F.when(F.col("priority_group") == C.CHAMPIONS, 2)
            .when(F.col("priority_group") == C.STABLE_MONITOR, 3).otherwise(1))
    band_name = F.when(band == 1, "Retain").when(band == 2, "Grow").otherwise("Monitor")
    w = Window.orderBy(band, F.col("total_HRR").desc(), F.col("priority_group"))  # 7 rows
    return plan.select(F.row_number().over(w).alias("playbook_rank"), band_name.alias("band"),
                       "priority_group", "n_customers", "total_HRR", "intervention_intensity")


UNMATCHED_SUMMARY_LABEL = "UNMATCHED (Medium/High risk, no segment)"


def segment_medians(actions: DataFrame) -> DataFrame:
    """Behavioural medians per group as the segment summary stores them: the
    default bucket is absent and the residual group carries the summary's own
    label."""
    label = F.when(F.col("priority_group") == C.UNMATCHED_AT_RISK, F.lit(UNMATCHED_SUMMARY_LABEL)) \
        .otherwise(F.col("priority_group"))
    named = actions.where(F.col("priority_group") != C.STABLE_MONITOR).withColumn("label", label)
    agg = named.groupBy("label").agg((F.avg(F.col("latest_is_auto_renew").cast("double")) * 100.0).alias("auto_renew_rate_pct"))
    return RA.with_quantiles(agg, named, ["label"], {
        "median_days_since_last_txn": ("days_since_last_txn", 0.5), "median_tenure_days": ("tenure_days_at_cutoff", 0.5)})


def segment_context(plan: DataFrame, medians: DataFrame) -> DataFrame:
    """C11: plan rows left-joined to the medians through the label alias."""
    alias = F.when(F.col("priority_group") == C.UNMATCHED_AT_RISK, F.lit(UNMATCHED_SUMMARY_LABEL)) \
        .otherwise(F.col("priority_group"))
    return (plan.withColumn("label", alias).join(medians, "label", "left")
            .select(F.col("priority_group").alias("segment"), "n_customers", "pct_of_base", "churn_rate_pct", "total_HRR",
                    "median_HRR", "intervention_intensity", "median_days_since_last_txn", "median_tenure_days",
                    "auto_renew_rate_pct"))


def compare_to_champions(plan: DataFrame, vbs: DataFrame) -> DataFrame:
    """Every group beside the Champions row (both inputs have <= 7 rows; the
    benchmark is read with whole-frame windows instead of a cross join)."""
    whole = Window.partitionBy()
    champ_churn = F.max(F.when(F.col("priority_group") == C.CHAMPIONS, F.col("churn_rate_pct"))).over(whole)
    champ_med = vbs.where(F.col("segment") == C.CHAMPIONS).select("median_HRR").first()  # one value
    return plan.select(F.col("priority_group").alias("segment"), F.col("churn_rate_pct").alias("subject_churn_rate_pct"),
                       F.col("total_HRR").alias("subject_total_hrr"), champ_churn.alias("champions_churn_rate_pct"),
                       F.lit(champ_med["median_HRR"] if champ_med else None).cast("double").alias("champions_median_hrr"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["INTENSITY"]
