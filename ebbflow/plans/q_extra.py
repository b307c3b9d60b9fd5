"""Registered queries under the inventory's own key names: single bucket columns,
the matrix pivots, single ranking metrics, reproduction check, queue export
(A10, B14, C9, D16, D17, H12, H13, H28)."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions import expr as X
from ebbflow.operators import curves as CU
from ebbflow.operators import quality as QU
from ebbflow.operators import segments as SG
from ebbflow.operators import serving as SV
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import order_values, q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.q_features import BUCKETS, bucket_sql
from ebbflow.plans.q_scoring import _rank_sql
from ebbflow.plans.q_segments import _matrix_sql, risk_value_matrix
from ebbflow.plans.q_serving import LK_D, ql
from ebbflow.plans.registry import register


def _bucket_query(name):
    col, edges, labels = BUCKETS[name]

    @register(name.replace("_bucket", "_buckets"), q(f"SELECT msno, {col}, {bucket_sql(col, edges, labels)} AS {name} FROM ds"))
    def fn(spark, sf):
        ds = Chain.shared(spark, sf).dataset()
        return ds.select("msno", col, X.right_closed_bucket(col, edges, labels).alias(name))
    fn.__doc__ = f"B14: right-closed bucket of {col}; outside or missing -> NULL."
    return fn


for _b in BUCKETS:
    _bucket_query(_b)


register("matrix_wide_join", _matrix_sql())(risk_value_matrix)


def _pivot_sql(agg, name, dtype="DOUBLE"):
    cols = ", ".join(f"CAST(MAX(CASE WHEN value_tier = '{v}' THEN x END) AS {dtype}) AS \"{v}\"" for v in C.TIER_ORDER)
    return q(f"""
, cells AS (SELECT risk_tier, value_tier, {agg} AS x FROM vt GROUP BY risk_tier, value_tier),
w AS (SELECT risk_tier, {cols} FROM cells GROUP BY risk_tier)
SELECT o.risk_tier, o.risk_tier_order, {", ".join(f'w."{v}"' for v in C.TIER_ORDER)}
FROM {order_values("risk_tier", C.TIER_ORDER)} o LEFT JOIN w ON w.risk_tier = o.risk_tier""")


def _pivot(spark, sf, agg):
    vt = Chain.shared(spark, sf).value_tiers()
    wide = vt.groupBy("risk_tier").pivot("value_tier", C.TIER_ORDER).agg(agg)
    order = small_frame(spark, [(v, i + 1) for i, v in enumerate(C.TIER_ORDER)], "risk_tier string, risk_tier_order int")
    return order.join(wide, "risk_tier", "left")


@register("risk_value_counts", _pivot_sql("COUNT(*)", "n", "BIGINT"))
def risk_value_counts(spark, sf):
    """Crosstab counts risk tier x value tier (fixed pivot list)."""
    return _pivot(spark, sf, F.count(F.lit(1)))


@register("risk_value_pct", sql_final(_pivot_sql("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM vt)", "pct"), list(C.TIER_ORDER)))
def risk_value_pct(spark, sf):
    """Crosstab normalised over ALL customers (unknown value tier in the denominator)."""
    n = Chain.shared(spark, sf).value_tiers().count()  # one scalar
    return finalize(_pivot(spark, sf, F.count(F.lit(1)) * 100.0 / F.lit(float(n))))


@register("risk_value_churn", sql_final(_pivot_sql("AVG(is_churn) * 100.0", "churn"), list(C.TIER_ORDER)))
def risk_value_churn(spark, sf):
    """Churn % per cell (pivot of means)."""
    return finalize(_pivot(spark, sf, F.avg(F.col("is_churn").cast("double")) * 100.0))


@register("risk_value_avg_hrr", sql_final(_pivot_sql("AVG(CAST(total_revenue AS DOUBLE))", "avg"), list(C.TIER_ORDER)))
def risk_value_avg_hrr(spark, sf):
    """Mean revenue per cell."""
    return finalize(_pivot(spark, sf, F.avg(F.col("total_revenue").cast("double"))))


@register("roc_auc", sql_final(q(f"SELECT score_column, roc_auc FROM ({_rank_sql('risk_score_full')} UNION ALL "
                                 f"{_rank_sql('risk_score_proxy_controlled')}) x"), ["roc_auc"]))
def roc_auc(spark, sf):
    """ROC-AUC with tied scores counted one half (trapezoid over distinct scores)."""
    s = Chain.shared(spark, sf).scored()
    parts = [CU.ranking_metrics(s, c).select(F.lit(c).alias("score_column"), "roc_auc")
             for c in ["risk_score_full", "risk_score_proxy_controlled"]]
    return finalize(parts[0].unionByName(parts[1]))


@register("average_precision", sql_final(q(f"SELECT score_column, pr_auc AS average_precision FROM ({_rank_sql('risk_score_full')} "
                                           f"UNION ALL {_rank_sql('risk_score_proxy_controlled')}) x"), ["average_precision"]))
def average_precision(spark, sf):
    """Step-wise average precision (no interpolation)."""
    s = Chain.shared(spark, sf).scored()
    parts = [CU.ranking_metrics(s, c).select(F.lit(c).alias("score_column"), F.col("pr_auc").alias("average_precision"))
             for c in ["risk_score_full", "risk_score_proxy_controlled"]]
    return finalize(parts[0].unionByName(parts[1]))


@register("reproduction_check", sql_final(q(f"""
, a AS ({_rank_sql('risk_score_full')}),
cp AS (SELECT SUM(pos * CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) / MAX(P) AS ap FROM (
         SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                SUM(pos) OVER () AS P
         FROM (SELECT risk_score_full AS score, SUM(is_churn) * 1.0 AS pos, SUM(1 - is_churn) * 1.0 AS neg FROM pred GROUP BY 1)))
SELECT 'pr_auc' AS metric, cp.ap AS recomputed, a.pr_auc AS stored, abs(cp.ap - a.pr_auc) AS abs_diff,
       abs(cp.ap - a.pr_auc) <= 1e-4 AS ok FROM cp CROSS JOIN a"""), ["recomputed", "stored", "abs_diff"]))
def reproduction_check(spark, sf):
    """PR-AUC recomputed from the stored per-customer predictions against the
    summary's value, within 1e-4 (the job would raise on a miss)."""
    ch = Chain.shared(spark, sf)
    stored = CU.ranking_metrics(ch.scored(), "risk_score_full").select(F.lit("pr_auc").alias("metric"), "pr_auc")
    kept = ch.committed("risk_scoring_predictions", lambda: ch.predictions().select(
        "msno", "is_churn", "risk_score_full", "risk_score_proxy_controlled", "risk_tier"))
    re = CU.ranking_metrics(kept, "risk_score_full").select(F.lit("pr_auc").alias("metric"), "pr_auc")
    return finalize(QU.reproduction_check(re, stored, "metric", "pr_auc", 1e-4))


@register("queue_export", sql_final(ql("""
SELECT msno, risk_tier, calibrated_probability, risk_score_full, total_revenue, segment FROM lk
WHERE risk_tier IN ('High', 'Medium') ORDER BY risk_score_full DESC NULLS LAST, msno LIMIT 500"""), ["calibrated_probability"]))
def queue_export(spark, sf):
    """A10: the columns of the priority queue that the CSV export writes
    (``sources.readers.export_queue`` writes them from the executors)."""
    lk = Chain.shared(spark, sf).lookup()
    q500 = SV.top_k(SV.filter_lookup(lk, risk_tiers=("High", "Medium")), C.QUEUE_CAP)
    return finalize(q500.select("msno", "risk_tier", "calibrated_probability", "risk_score_full", "total_revenue", "segment"))


__all__ = ["SG", "LK_D"]
