"""Registered queries: segments, value tiers, risk x value matrix, action plan
(B15, B17-B20, C9, D12-D19, D40, D45, E2, E3, F3, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.operators import segments as SG
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import _str, order_values, q, recommend_case
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.registry import register

CHAR_AVG = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS {c}" for c in C.CHAR_COLS)


CHAR_DOUBLES = ["auto_renew_pct", "avg_revenue_per_txn", "discount_rate", "cancel_rate"]


@register("assign_segment", sql_final(q("SELECT msno, is_churn, risk_tier, segment, " + ", ".join(C.CHAR_COLS) + " FROM seg"),
                                      CHAR_DOUBLES))
def assign_segment(spark, sf):
    """customer_segments (first-match rules, NULL falls through)."""
    return finalize(SG.customer_segments(Chain.shared(spark, sf).predictions()))


def _profile_sql(key, order, src):
    return sql_final(q(f"""
SELECT o.{key}, o.{key}_order, CAST(COALESCE(g.n_customers, 0) AS BIGINT) AS n_customers,
       g.n_customers * 100.0 / SUM(g.n_customers) OVER () AS pct_of_base, g.is_churn, {", ".join("g." + c for c in C.CHAR_COLS)}
FROM {order_values(key, order)} o
LEFT JOIN (SELECT {key}, COUNT(*) AS n_customers, AVG(is_churn) AS is_churn, {CHAR_AVG} FROM {src} GROUP BY {key}) g
  ON g.{key} = o.{key}"""), ["pct_of_base", "is_churn"] + C.CHAR_COLS)


@register("tier_profile", _profile_sql("risk_tier", C.TIER_ORDER, "pred"))
def tier_profile(spark, sf):
    """Behaviour means, churn, n, % of base per risk tier."""
    return finalize(SG.tier_profile(Chain.shared(spark, sf).predictions()))


@register("segment_summary", _profile_sql("segment", C.SEGMENT_ORDER, "seg"))
def segment_summary(spark, sf):
    """The same per segment."""
    return finalize(SG.segment_summary(Chain.shared(spark, sf).segments()))


@register("unmatched_at_risk", sql_final(q("""
SELECT CAST(COUNT(*) FILTER (WHERE risk_tier IN ('High', 'Medium') AND segment = 'Stable / Monitor') AS BIGINT) AS n_unmatched,
       CAST(COUNT(*) FILTER (WHERE risk_tier IN ('High', 'Medium')) AS BIGINT) AS n_at_risk,
       COUNT(*) FILTER (WHERE risk_tier IN ('High', 'Medium') AND segment = 'Stable / Monitor') * 100.0
         / NULLIF(COUNT(*) FILTER (WHERE risk_tier IN ('High', 'Medium')), 0) AS pct_of_at_risk FROM seg"""), ["pct_of_at_risk"]))
def unmatched_at_risk(spark, sf):
    """At-risk customers matching no named segment."""
    return finalize(SG.unmatched_at_risk(Chain.shared(spark, sf).segments()))


@register("monthly_revenue_rate", sql_final(q("SELECT msno, total_revenue, tenure_days_at_cutoff, "
                                              "CASE WHEN tenure_days_at_cutoff IS NOT NULL THEN total_revenue / greatest(tenure_days_at_cutoff / 30.44, 1.0) END AS monthly_revenue_rate FROM ds"),
                                            ["monthly_revenue_rate"]))
def monthly_revenue_rate(spark, sf):
    """Revenue per tenure month (floor one month)."""
    ds = Chain.shared(spark, sf).dataset().select("msno", "total_revenue", "tenure_days_at_cutoff")
    return finalize(SG.monthly_revenue_rate(ds))


@register("tercile_edges", sql_final(q("SELECT e1 AS edge_low, e2 AS edge_high FROM edges"), ["edge_low", "edge_high"]))
def tercile_edges(spark, sf):
    """E2 edges: linear 1/3 and 2/3 revenue quantiles of customers with transactions."""
    return finalize(SG.tercile_edges(Chain.shared(spark, sf).scored()))


@register("value_tiers", q("SELECT msno, is_churn, risk_tier, segment, total_revenue, value_tier FROM vt"))
def value_tiers(spark, sf):
    """customer_value_tiers (terciles, ties kept together, unknown tier)."""
    return SG.customer_value_tiers(Chain.shared(spark, sf).value_tiers())


VBT_D = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@register("value_by_risk_tier", sql_final(q("""
SELECT risk_tier, CAST(COUNT(total_revenue) AS BIGINT) AS count, AVG(CAST(total_revenue AS DOUBLE)) AS mean,
       stddev_samp(CAST(total_revenue AS DOUBLE)) AS std, CAST(MIN(total_revenue) AS DOUBLE) AS min,
       quantile_cont(CAST(total_revenue AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(total_revenue AS DOUBLE), 0.5) AS p50,
       quantile_cont(CAST(total_revenue AS DOUBLE), 0.75) AS p75, CAST(MAX(total_revenue) AS DOUBLE) AS max,
       CAST(SUM(total_revenue) AS BIGINT) AS total_HRR_sum
FROM vt WHERE has_transactions_data = 1 GROUP BY risk_tier"""), VBT_D))
def value_by_risk_tier(spark, sf):
    """describe() of revenue per tier plus its sum."""
    return finalize(SG.value_by_risk_tier(Chain.shared(spark, sf).value_tiers()))


@register("value_by_segment", sql_final(q("""
SELECT segment, CAST(COUNT(*) AS BIGINT) AS n_customers, median(CAST(total_revenue AS DOUBLE)) AS median_HRR,
       AVG(CAST(total_revenue AS DOUBLE)) AS mean_HRR, CAST(SUM(total_revenue) AS BIGINT) AS total_HRR,
       SUM(total_revenue) * 100.0 / SUM(SUM(total_revenue)) OVER () AS pct_of_total_HRR
FROM vt WHERE has_transactions_data = 1 GROUP BY segment"""), ["median_HRR", "mean_HRR", "pct_of_total_HRR"]))
def value_by_segment(spark, sf):
    """Revenue count / median / mean / sum per segment and share of total."""
    return finalize(SG.value_by_segment(Chain.shared(spark, sf).value_tiers()))


@register("risk_value_cells", sql_final(q("""
SELECT risk_tier, value_tier, CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS pct,
       AVG(is_churn) * 100.0 AS churn_rate_pct, AVG(CAST(total_revenue AS DOUBLE)) AS avg_hrr
FROM vt GROUP BY risk_tier, value_tier"""), ["pct", "churn_rate_pct", "avg_hrr"]))
def risk_value_cells(spark, sf):
    """D16/D17 long form: crosstab count, % of all customers, churn, mean revenue."""
    return finalize(SG.risk_value_cells(Chain.shared(spark, sf).value_tiers()))


def _matrix_sql():
    cols = []
    for metric, agg in [("n", "CAST(COALESCE(SUM(CASE WHEN value_tier = '{v}' THEN n END), 0) AS BIGINT)"),
                        ("pct", "MAX(CASE WHEN value_tier = '{v}' THEN pct END)"),
                        ("churn_rate_pct", "MAX(CASE WHEN value_tier = '{v}' THEN churn_rate_pct END)"),
                        ("avg_hrr", "MAX(CASE WHEN value_tier = '{v}' THEN avg_hrr END)")]:
        for v in C.TIER_ORDER:
            cols.append(agg.format(v=v) + f" AS {metric}_{v}")
    recs = [recommend_case("o.risk_tier", _str(v)) + f" AS recommendation_{v}" for v in C.TIER_ORDER]
    body = f"""
, cells AS (SELECT risk_tier, value_tier, COUNT(*) AS n, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS pct,
                   AVG(is_churn) * 100.0 AS churn_rate_pct, AVG(CAST(total_revenue AS DOUBLE)) AS avg_hrr
            FROM vt GROUP BY risk_tier, value_tier),
wide AS (SELECT risk_tier, {", ".join(cols)} FROM cells GROUP BY risk_tier)
SELECT o.risk_tier, o.risk_tier_order, {", ".join(f"COALESCE(w.n_{v}, 0) AS n_{v}" for v in C.TIER_ORDER)},
       {", ".join(f"w.{m}_{v}" for m in ["pct", "churn_rate_pct", "avg_hrr"] for v in C.TIER_ORDER)}, {", ".join(recs)}
FROM {order_values("risk_tier", C.TIER_ORDER)} o LEFT JOIN wide w ON w.risk_tier = o.risk_tier"""
    return sql_final(q(body), [f"{m}_{v}" for m in ["pct", "churn_rate_pct", "avg_hrr"] for v in C.TIER_ORDER])


@register("risk_value_matrix", _matrix_sql())
def risk_value_matrix(spark, sf):
    """C9 + D16 + D17: the wide risk x value matrix from one pivot with a fixed value list."""
    return finalize(SG.risk_value_matrix(Chain.shared(spark, sf).value_tiers()))


@register("recommend_cell", q("SELECT msno, risk_tier, value_tier, recommendation FROM act"))
def recommend_cell(spark, sf):
    """Per-customer risk x value recommendation."""
    return Chain.shared(spark, sf).customer_actions().select("msno", "risk_tier", "value_tier", "recommendation")


@register("resolve_priority_group", q("SELECT msno, risk_tier, segment AS segment_file_label, priority_group FROM act"))
def resolve_priority_group(spark, sf):
    """Residual relabel, original label kept beside it."""
    return Chain.shared(spark, sf).customer_actions().select("msno", "risk_tier", F.col("segment").alias("segment_file_label"),
                                                      "priority_group")


@register("lookup_map", q("SELECT msno, recommendation, intervention_intensity FROM act"))
def lookup_map(spark, sf):
    """Recommendation -> intensity label (fixed 7-entry map)."""
    return Chain.shared(spark, sf).customer_actions().select("msno", "recommendation", "intervention_intensity")


@register("value_cells", sql_final(q("""
SELECT risk_tier, value_tier, CAST(COUNT(*) AS BIGINT) AS n_customers,
       COUNT(*) * 100.0 / (SELECT COUNT(*) FROM vt) AS pct_of_base, AVG(is_churn) * 100.0 AS churn_rate_pct,
       median(CAST(total_revenue AS DOUBLE)) AS median_HRR, CAST(SUM(total_revenue) AS BIGINT) AS total_HRR,
       AVG(latest_is_auto_renew) * 100.0 AS auto_renew_rate_pct
FROM vt WHERE has_transactions_data = 1 GROUP BY risk_tier, value_tier"""),
    ["pct_of_base", "churn_rate_pct", "median_HRR", "auto_renew_rate_pct"]))
def value_cells(spark, sf):
    """Per risk x value cell n, % base, churn, median / total revenue, auto-renew rate."""
    return finalize(SG.value_cells(Chain.shared(spark, sf).value_tiers()))


PLAN_SQL = f"""
, base AS (SELECT priority_group, COUNT(*) AS n, AVG(is_churn) AS churn,
                  SUM(CASE WHEN value_tier <> {_str(C.VALUE_UNKNOWN)} THEN total_revenue END) AS hrr,
                  median(CASE WHEN value_tier <> {_str(C.VALUE_UNKNOWN)} THEN CAST(total_revenue AS DOUBLE) END) AS med
           FROM act GROUP BY priority_group),
rc AS (SELECT priority_group, recommendation, COUNT(*) AS k FROM act GROUP BY ALL),
md AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY priority_group ORDER BY k DESC, recommendation) AS rn FROM rc)
       WHERE rn = 1),
plan AS (
SELECT o.priority_group, o.priority_group_order, CAST(COALESCE(b.n, 0) AS BIGINT) AS n_customers,
       round(COALESCE(b.n, 0) * 100.0 / SUM(b.n) OVER (), 2) AS pct_of_base, round(b.churn * 100.0, 2) AS churn_rate_pct,
       round(COALESCE(CAST(b.hrr AS DOUBLE), 0.0), 2) AS total_HRR, round(b.med, 2) AS median_HRR,
       CASE {" ".join(f"WHEN md.recommendation = {_str(k)} THEN {_str(v)}" for k, v in SG.INTENSITY.items())} END
         AS intervention_intensity,
       md.recommendation AS dominant_risk_value_recommendation,
       round(md.k * 100.0 / b.n, 1) AS pct_matching_dominant_recommendation
FROM {order_values("priority_group", C.GROUP_ORDER)} o LEFT JOIN base b ON b.priority_group = o.priority_group
LEFT JOIN md ON md.priority_group = o.priority_group)"""
PLAN_D = ["pct_of_base", "churn_rate_pct", "total_HRR", "median_HRR", "pct_matching_dominant_recommendation"]


@register("action_plan", sql_final(q(PLAN_SQL + "\nSELECT * FROM plan"), PLAN_D))
def action_plan(spark, sf):
    """The seven-row marketing action plan."""
    return finalize(SG.action_plan(Chain.shared(spark, sf).customer_actions()))


@register("segment_group_counts", q("""
, pl AS (SELECT priority_group, COUNT(*) AS n FROM act GROUP BY 1),
rl AS (SELECT CASE WHEN risk_tier IN ('High', 'Medium') AND segment = 'Stable / Monitor'
                   THEN 'Unmatched At-Risk (no segment)' ELSE segment END AS priority_group, COUNT(*) AS n FROM seg GROUP BY 1)
SELECT COALESCE(pl.priority_group, rl.priority_group) AS priority_group, CAST(COALESCE(pl.n, 0) AS BIGINT) AS n_plan,
       CAST(COALESCE(rl.n, 0) AS BIGINT) AS n_relabeled, COALESCE(pl.n, 0) = COALESCE(rl.n, 0) AS equal
FROM pl FULL OUTER JOIN rl ON pl.priority_group = rl.priority_group"""))
def segment_group_counts(spark, sf):
    """Group sizes after relabel equal the action plan's."""
    ch = Chain.shared(spark, sf)
    plan = ch.committed("marketing_action_plan", lambda: SG.action_plan_full(ch.customer_actions()))
    return SG.segment_group_counts(plan, ch.segments())


@register("priority_opportunities", sql_final(q(PLAN_SQL + """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY total_HRR DESC, priority_group) AS INTEGER) AS priority_rank, priority_group,
       n_customers, total_HRR, churn_rate_pct, intervention_intensity
FROM plan WHERE priority_group NOT IN ('Engaged Low-Risk (Champions)', 'Stable / Monitor')"""), ["total_HRR", "churn_rate_pct"]))
def priority_opportunities(spark, sf):
    """F3 + E3: retention groups ranked by revenue."""
    return finalize(SG.priority_opportunities(SG.action_plan(Chain.shared(spark, sf).customer_actions())))


@register("playbook", sql_final(q(PLAN_SQL + """
, pb AS (SELECT *, CASE WHEN priority_group = 'Engaged Low-Risk (Champions)' THEN 2
                        WHEN priority_group = 'Stable / Monitor' THEN 3 ELSE 1 END AS band FROM plan)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY band, total_HRR DESC, priority_group) AS INTEGER) AS playbook_rank,
       CASE band WHEN 1 THEN 'Retain' WHEN 2 THEN 'Grow' ELSE 'Monitor' END AS band, priority_group, n_customers,
       total_HRR, intervention_intensity FROM pb""").replace(") \n, pb AS", "),\npb AS"), ["total_HRR"]))
def playbook(spark, sf):
    """all seven groups banded retain -> grow -> monitor."""
    return finalize(SG.playbook(SG.action_plan(Chain.shared(spark, sf).customer_actions())))
