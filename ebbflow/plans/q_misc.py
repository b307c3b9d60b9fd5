"""Registered queries: error analysis, join checks, metric deltas, stacking,
question intents and sampling (B35, B37, C6, C7, C14, C15, D20, D21, G1)."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow import config as C
from ebbflow.functions import expr as X
from ebbflow.operators import curves as CU
from ebbflow.operators import quality as QU
from ebbflow.operators import scoring as SC
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import hash_u, q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.q_scoring import _cls_sql_both, _rank_sql
from ebbflow.plans.registry import register

# Features profiled per confusion group.
ERROR_FEATURES = ["latest_is_auto_renew", "auto_renew_pct", "days_since_last_txn", "tenure_days_at_cutoff",
                  "total_transactions", "avg_revenue_per_txn", "total_revenue", "latest_is_cancel",
                  "membership_remaining_days", "cancel_rate"]
CG_SQL = ("CASE WHEN risk_score_full >= 0.65 AND is_churn = 1 THEN 'TP' WHEN risk_score_full >= 0.65 THEN 'FP' "
          "WHEN is_churn = 1 THEN 'FN' ELSE 'TN' END")


def stage_predictions(ch: Chain) -> DataFrame:
    return ch.predictions().select("msno", "is_churn", "risk_score_full", "risk_score_proxy_controlled", "risk_tier")


def _errors(spark, sf):
    s = Chain.shared(spark, sf).scored()
    return s.withColumn("confusion_group", X.confusion_group("risk_score_full", "is_churn"))


@register("error_group_medians", sql_final(q(f"SELECT {CG_SQL} AS confusion_group, " + ", ".join(
    f"median(CAST({c} AS DOUBLE)) AS {c}" for c in ERROR_FEATURES) + " FROM sc GROUP BY 1"), ERROR_FEATURES))
def error_group_medians(spark, sf):
    """Medians of ten features by confusion group at 0.65."""
    e = _errors(spark, sf)
    return finalize(RA.quantiles(e, ["confusion_group"], {c: (c, 0.5) for c in ERROR_FEATURES}))


@register("top_category_per_group", sql_final(q(f"""
, pm AS (SELECT {CG_SQL} AS confusion_group, latest_payment_method_id AS m, COUNT(*) AS k FROM sc
         WHERE latest_payment_method_id IS NOT NULL GROUP BY ALL)
SELECT confusion_group, m AS most_common_payment_method_id, round(k * 100.0 / tot, 1) AS share_of_group FROM (
  SELECT *, SUM(k) OVER (PARTITION BY confusion_group) AS tot,
         ROW_NUMBER() OVER (PARTITION BY confusion_group ORDER BY k DESC, m) AS rn FROM pm) WHERE rn = 1"""), ["share_of_group"]))
def top_category_per_group(spark, sf):
    """Most frequent latest payment method per confusion group and its share
    (ties -> smallest id).  Two-level aggregation; the window runs on the
    (group, method) counts."""
    e = _errors(spark, sf).where(F.col("latest_payment_method_id").isNotNull())
    c = e.groupBy("confusion_group", F.col("latest_payment_method_id").alias("m")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("confusion_group")
    r = (c.withColumn("tot", F.sum("k").over(w))
         .withColumn("rn", F.row_number().over(w.orderBy(F.col("k").desc(), F.col("m")))).where(F.col("rn") == 1))
    return finalize(r.select("confusion_group", F.col("m").alias("most_common_payment_method_id"),
                             F.round(F.col("k") * 100.0 / F.col("tot"), 1).alias("share_of_group")))


@register("attach_scores", q("SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) FILTER (WHERE p.risk_tier IS NULL) AS BIGINT) AS n_missing "
                             "FROM ds LEFT JOIN pred p ON p.msno = ds.msno"))
def attach_scores(spark, sf):
    """Features left-joined to scores; the completeness count must be zero."""
    ch = Chain.shared(spark, sf)
    stored = ch.committed("risk_scoring_predictions", lambda: stage_predictions(ch))
    j = QU.attach_with_completeness(ch.build_dataset().select("msno"), stored, ["risk_tier"])
    return QU.completeness(j, "risk_tier")


@register("aligned_lookup", q("""
SELECT CAST(COUNT(*) AS BIGINT) AS n_holdout, CAST(COUNT(p.msno) AS BIGINT) AS n_matched,
       CAST((SELECT COUNT(*) - COUNT(DISTINCT msno) FROM pred) AS BIGINT) AS n_duplicate_keys,
       CAST(COUNT(*) FILTER (WHERE p.msno IS NULL) AS BIGINT) AS n_missing,
       CAST(COUNT(*) FILTER (WHERE p.is_churn <> l.is_churn) AS BIGINT) AS n_label_mismatch
FROM sc l LEFT JOIN pred p ON p.msno = l.msno"""))
def aligned_lookup(spark, sf):
    """Key-aligned lookup of stored predictions for the holdout: unique key,
    full cover, equal labels (order is irrelevant in Spark)."""
    ch = Chain.shared(spark, sf)
    stored = ch.committed("risk_scoring_predictions", lambda: stage_predictions(ch))
    return QU.aligned_lookup(ch.scored(), stored)


@register("reconcile_labels", q("""
, st AS (SELECT msno, priority_group AS label FROM act),
rs AS (SELECT msno, CASE WHEN risk_tier IN ('High', 'Medium') AND segment = 'Stable / Monitor'
                         THEN 'Unmatched At-Risk (no segment)' ELSE segment END AS label FROM seg)
SELECT CAST(COUNT(st.label) AS BIGINT) AS n_stored, CAST(COUNT(rs.label) AS BIGINT) AS n_resolved,
       CAST(COUNT(*) FILTER (WHERE st.label IS NULL OR rs.label IS NULL) AS BIGINT) AS n_unpaired,
       CAST(COUNT(*) FILTER (WHERE st.label <> rs.label) AS BIGINT) AS n_mismatch
FROM st FULL OUTER JOIN rs ON st.msno = rs.msno"""))
def reconcile_labels(spark, sf):
    """C14: the action plan's stored group vs the label resolved from the
    per-customer segment file: row counts and mismatches."""
    ch = Chain.shared(spark, sf)
    acts = ch.customer_actions()
    stored = ch.committed("customer_actions", lambda: acts.select("msno", "priority_group", "risk_tier", "segment")).select(
        "msno", F.col("priority_group").alias("label"))
    resolved = ch.segments().select("msno", X.priority_group("risk_tier", "segment").alias("label"))
    return QU.reconcile_labels(stored, resolved)


METRICS = ["pr_auc", "roc_auc", "precision", "recall", "f1", "log_loss", "brier"]


@register("metric_deltas", sql_final(q(f"""
, rk AS ({_rank_sql('risk_score_full')} UNION ALL {_rank_sql('risk_score_proxy_controlled')}),
cl AS ({_cls_sql_both(0.5)}),
wide AS (SELECT rk.score_column, rk.pr_auc, rk.roc_auc, cl.precision, cl.recall, cl.f1, cl.log_loss, cl.brier
         FROM rk JOIN cl ON cl.score_column = rk.score_column),
lng AS (UNPIVOT wide ON {", ".join(METRICS)} INTO NAME metric VALUE v)
SELECT f.metric, f.v AS full_feature_set, p.v AS proxy_controlled_set, f.v - p.v AS abs_diff
FROM lng f JOIN lng p ON f.metric = p.metric
WHERE f.score_column = 'risk_score_full' AND p.score_column = 'risk_score_proxy_controlled'"""),
    ["full_feature_set", "proxy_controlled_set", "abs_diff"]))
def metric_deltas(spark, sf):
    """Two metric sets side by side with their difference, from four one-row aggregates."""
    s = Chain.shared(spark, sf).scored()

    def values(col):  # two one-row aggregates -> seven scalars
        r = CU.ranking_metrics(s, col).first().asDict()
        r.update(SC.classification_metrics(s, col, "is_churn", 0.5).first().asDict())
        return r
    f, p = values("risk_score_full"), values("risk_score_proxy_controlled")
    rows = [(m, f[m], p[m], f[m] - p[m]) for m in METRICS]
    return finalize(small_frame(spark, rows, "metric string, full_feature_set double, proxy_controlled_set double, "
                                                "abs_diff double"))


@register("union_results", sql_final(q("SELECT 'full' AS model, * FROM sweep UNION ALL "
                                       "SELECT 'proxy_controlled', g.threshold, "
                                       "CASE WHEN SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) > 0 "
                                       "THEN SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END) "
                                       "/ SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) ELSE 0.0 END, "
                                       "SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END) / SUM(s.is_churn), "
                                       "2.0 * SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END) "
                                       "/ (SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) + SUM(s.is_churn)), "
                                       "SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) * 100.0 / COUNT(*), "
                                       "CAST(SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) "
                                       "FROM grid g CROSS JOIN sc s GROUP BY g.threshold"),
                                     ["threshold", "precision", "recall", "f1", "pct_targeted"]))
def union_results(spark, sf):
    """G1: per-model result frames stacked by name."""
    ch = Chain.shared(spark, sf)
    parts = [ch.sweep(c).select(F.lit(m).alias("model"), "*")
             for m, c in [("full", "risk_score_full"), ("proxy_controlled", "risk_score_proxy_controlled")]]
    return finalize(reduce(DataFrame.unionByName, parts))


def _intent_sql():
    def has(*ws):
        return "(" + " OR ".join(f"contains(t, '{w}')" for w in ws) + ")"
    cust = ("CASE WHEN " + has("discount", "price") + " THEN 'discount' WHEN " + has("champion", "compare")
            + " THEN 'compare_champions' WHEN " + has("nothing", "do nothing", "no action") + " THEN 'what_if_nothing' WHEN ("
            + has("worth retain", "worth saving", "worth it") + " OR (" + has("value") + " AND " + has("worth")
            + ")) THEN 'worth_retaining' WHEN " + has("prioriti") + " THEN 'prioritized_reasons' WHEN " + has("evidence", "support")
            + " THEN 'evidence_only' WHEN " + has("why") + " AND " + has("risk") + " THEN 'why_at_risk' WHEN "
            + has("what should we do", "what to do", "next", "recommend") + " THEN 'what_to_do' WHEN " + has("why")
            + " THEN 'why_at_risk' ELSE 'unknown' END")
    seg = ("CASE WHEN " + has("champion") + " AND " + has("important", "why") + " THEN 'champions_importance' WHEN "
           + has("prioriti") + " AND " + has("which", "segment") + " THEN 'which_segment_priority' WHEN "
           + has("high-touch", "high touch", "deserve") + " THEN 'high_touch_candidates' ELSE 'segment_overview' END")
    return (f"SELECT role, customer_intent, segment_intent, CAST(COUNT(*) AS BIGINT) AS n_questions FROM ("
            f"SELECT {cust} AS customer_intent, {seg} AS segment_intent, role FROM (SELECT lower(text) AS t, role FROM conversations"
            f")) GROUP BY ALL")


@register("question_intent", _intent_sql())
def question_intent(spark, sf):
    """B35 (re-aimed): first-match keyword intents of every turn in the
    conversations table, counted per (role, customer intent, segment intent)."""
    conv = Chain.shared(spark, sf).tables.conversations()
    return conv.select("role", X.question_intent("text").alias("customer_intent"),
                       X.segment_intent("text").alias("segment_intent")).groupBy(
        "role", "customer_intent", "segment_intent").agg(F.count(F.lit(1)).alias("n_questions"))


SAMPLE_N = 10_000


@register("row_sample", q(f"SELECT msno, risk_score_full FROM sc ORDER BY {hash_u(chr(109) + 'sno || ' + repr('sample'))}, msno LIMIT {SAMPLE_N}"))
def row_sample(spark, sf):
    """Exact-size seeded sample (10,000 rows): the rows with the smallest
    hash uniforms - a top-k, so no global sort or shuffle of the whole table."""
    from ebbflow.operators.sampling import exact_sample
    s = Chain.shared(spark, sf).scored().select("msno", "risk_score_full")
    return exact_sample(s, SAMPLE_N, salt="sample")
