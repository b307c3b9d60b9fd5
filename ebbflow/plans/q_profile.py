"""Registered queries: exploratory profiling of the v2 modeling table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.operators import profile as PR
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.q_features import BUCKETS, bucket_sql
from ebbflow.plans.registry import register

# Fixed values: (column, minimum group size) of the churn-rate-by-category views.
CHURN_BY = [("registered_via", 0), ("latest_is_auto_renew", 0), ("latest_is_cancel", 0),
            ("num_distinct_payment_methods", 30), ("city", 100)]
NUMERIC = C.BINARY_FLAGS + C.NUMERIC_CONTINUOUS


def _ds(spark, sf):
    return Chain.shared(spark, sf).dataset()


def _churn_by_sql():
    parts = [f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, AVG(is_churn) * 100.0 AS churn_rate_pct, "
             f"CAST(COUNT(*) AS BIGINT) AS n FROM ds WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) >= {m}"
             for c, m in CHURN_BY]
    return sql_final(q("SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY churn_rate_pct DESC, category) AS INTEGER) AS rank FROM ("
                       + " UNION ALL ".join(parts) + ") u"), ["churn_rate_pct"])


@register("churn_rate_by", _churn_by_sql())
def churn_rate_by(spark, sf):
    """Churn % and count by five categorical/binary columns (min group sizes), ranked."""
    ds = _ds(spark, sf)
    u = reduce(DataFrame.unionByName, [PR.churn_rate_by(ds, c, m) for c, m in CHURN_BY])
    return finalize(PR.rank_within(u, "feature", [F.col("churn_rate_pct").desc(), F.col("category")]))


@register("class_distribution", sql_final(q("SELECT is_churn, CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS pct "
                                            "FROM ds GROUP BY is_churn"), ["pct"]))
def class_distribution(spark, sf):
    """Class counts and shares."""
    return finalize(PR.class_distribution(_ds(spark, sf)))


@register("churn_by_bucket", sql_final(q(" UNION ALL ".join(
    f"SELECT '{name}' AS bucket_feature, bucket, CAST(COUNT(*) AS BIGINT) AS n, AVG(is_churn) * 100.0 AS churn_rate_pct "
    f"FROM (SELECT {bucket_sql(c, e, lab)} AS bucket, is_churn FROM ds) GROUP BY bucket"
    for name, (c, e, lab) in BUCKETS.items())), ["churn_rate_pct"]))
def churn_by_bucket(spark, sf):
    """Churn % per bucket of tenure, transactions, recency, remaining days (missing row included)."""
    return finalize(PR.churn_by_bucket(_ds(spark, sf), BUCKETS))


ALL_COLS = [c for c in ["is_churn"] + C.ALL_FEATURES]


@register("missingness", sql_final(q("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
    f"COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*) AS pct_missing FROM ds" for c in ALL_COLS)
    + ") WHERE n_missing > 0"), ["pct_missing"]))
def missingness(spark, sf):
    """% missing per column (only columns with any)."""
    return finalize(PR.missingness(_ds(spark, sf), ALL_COLS))


PROFILE_COLS = C.NUMERIC_CONTINUOUS


def _profile_sql():
    parts = []
    for c in PROFILE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*) AS pct_missing, MIN({x}) AS min, "
            f"quantile_cont({x}, 0.5) AS median, AVG({x}) AS mean, MAX({x}) AS max, CAST(COUNT(DISTINCT {x}) AS BIGINT) AS n_distinct, "
            f"(SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM ds WHERE {c} IS NOT NULL GROUP BY {c})) * 100.0 / COUNT({c}) AS top_share_pct FROM ds")
    return sql_final(q(" UNION ALL ".join(parts)), ["pct_missing", "min", "median", "mean", "max", "top_share_pct"])


@register("column_profile", _profile_sql())
def column_profile(spark, sf):
    """Missing %, min, median, mean, max, distinct count, top-value share per numeric column."""
    return finalize(PR.column_profile(_ds(spark, sf), PROFILE_COLS))


@register("target_means", sql_final(q(" UNION ALL ".join(
    f"SELECT '{c}' AS column, AVG(CASE WHEN is_churn = 0 THEN CAST({c} AS DOUBLE) END) AS mean_not_churned, "
    f"AVG(CASE WHEN is_churn = 1 THEN CAST({c} AS DOUBLE) END) AS mean_churned FROM ds" for c in NUMERIC)),
    ["mean_not_churned", "mean_churned"]))
def target_means(spark, sf):
    """Mean of each feature per class."""
    return finalize(PR.target_means(_ds(spark, sf), NUMERIC))


def _corr_sql(a, b, src="ds"):
    xa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    xb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({xa}, {xb}) / NULLIF(stddev_pop({xa}) * stddev_pop({xb}), 0)"


@register("corr_with_target", sql_final(q("SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY abs(r) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM ("
                                          + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr_sql(c, 'is_churn')} AS r FROM ds" for c in NUMERIC)
                                          + ")) WHERE rank <= 15"), ["r"]))
def corr_with_target(spark, sf):
    """Pearson r with the label (pairwise complete, constant -> NULL), top 15 by |r|."""
    return finalize(PR.corr_with_target(_ds(spark, sf), NUMERIC))


VALUE_CANDIDATES = ["total_revenue", "avg_revenue_per_txn", "latest_actual_amount_paid", "tenure_days_at_cutoff",
                    "total_transactions", "monthly_revenue_rate"]
MRR_SQL = "CASE WHEN tenure_days_at_cutoff IS NOT NULL THEN total_revenue / greatest(tenure_days_at_cutoff / 30.44, 1.0) END"


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("corr_matrix", sql_final(q(
    ", cand AS (SELECT *, " + MRR_SQL + " AS monthly_revenue_rate FROM ds)\n" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr_sql(a, b)} AS r FROM cand"
        for a, b in _pairs(VALUE_CANDIDATES))), ["r"]))
def corr_matrix(spark, sf):
    """Correlation matrix of the value-proxy candidates (all pairs, one aggregation)."""
    from ebbflow.operators.segments import monthly_revenue_rate
    ds = monthly_revenue_rate(_ds(spark, sf))
    return finalize(PR.corr_matrix(ds, VALUE_CANDIDATES))


@register("collinear_pairs", sql_final(q("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr_sql(a, b)} AS r FROM ds" for a, b in _pairs(NUMERIC))
    + ") WHERE abs(r) > 0.85"), ["r"]))
def collinear_pairs(spark, sf):
    """Feature pairs with |r| > 0.85 among all numeric features (one aggregation)."""
    return finalize(PR.collinear_pairs(_ds(spark, sf), NUMERIC))


@register("plan_days_by_churn_autorenew", sql_final(q("""
SELECT is_churn, latest_is_auto_renew, CAST(COUNT(*) AS BIGINT) AS n, quantile_cont(x, 0.25) AS q1,
       quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
FROM (SELECT is_churn, latest_is_auto_renew, CAST(greatest(0, least(400, latest_payment_plan_days)) AS DOUBLE) AS x FROM ds
      WHERE latest_is_auto_renew IS NOT NULL AND latest_payment_plan_days IS NOT NULL)
GROUP BY is_churn, latest_is_auto_renew"""), ["q1", "median", "q3"]))
def plan_days_by_churn_autorenew(spark, sf):
    """Quartiles of plan days (clipped at 400) by churn x auto-renew."""
    ds = _ds(spark, sf).where(F.col("latest_is_auto_renew").isNotNull())
    from ebbflow.functions.expr import clip_keep_null
    return finalize(PR.grouped_quartiles(ds, clip_keep_null("latest_payment_plan_days", 0, 400).cast("double"),
                                         ["is_churn", "latest_is_auto_renew"]))


# Fixed values: (column, bins, clip) of the distribution views.
HISTS = [("tenure_days_at_cutoff", 40, None), ("bd_clean", 40, (5, 80)), ("total_transactions", 30, (0, 50)),
         ("avg_revenue_per_txn", 40, (0, 600))]


def _hist_sql(c, bins, clip):
    x = f"CAST({c} AS DOUBLE)" if clip is None else f"CAST(greatest({clip[0]}, least({clip[1]}, {c})) AS DOUBLE)"
    return f"""
SELECT '{c}' AS feature, is_churn, bin, lo + bin * (hi - lo) / {bins} AS bin_lo, lo + (bin + 1) * (hi - lo) / {bins} AS bin_hi,
       CAST(COUNT(*) AS BIGINT) AS count, COUNT(*) / (MAX(n) * (hi - lo) / {bins}) AS density
FROM (SELECT d.is_churn, r.lo, r.hi, r.n,
             CAST(least({bins - 1}, floor((d.x - r.lo) * {bins} / (r.hi - r.lo))) AS INTEGER) AS bin
      FROM (SELECT is_churn, {x} AS x FROM ds WHERE {c} IS NOT NULL) d
      JOIN (SELECT is_churn, CASE WHEN MAX(x) = MIN(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS lo,
                   CASE WHEN MAX(x) = MIN(x) THEN MAX(x) + 0.5 ELSE MAX(x) END AS hi, COUNT(*) AS n
            FROM (SELECT is_churn, {x} AS x FROM ds WHERE {c} IS NOT NULL) GROUP BY is_churn) r ON r.is_churn = d.is_churn)
GROUP BY is_churn, bin, lo, hi"""


@register("histogram_by_class", sql_final(q(" UNION ALL ".join(_hist_sql(*h) for h in HISTS)), ["bin_lo", "bin_hi", "density"]))
def histogram_by_class(spark, sf):
    """Per-class equal-width density histograms of four features (clipped first)."""
    ds = _ds(spark, sf)
    return finalize(reduce(DataFrame.unionByName, [PR.histogram_by_class(ds, c, b, clip) for c, b, clip in HISTS]))


def _box_sql(value, by, src, where="TRUE"):
    x = f"CAST({value} AS DOUBLE)"
    return f"""
SELECT '{value}' AS feature, CAST(q.{by} AS VARCHAR) AS grp, q.n, q.q1, q.median, q.q3,
       MIN(CASE WHEN {x} >= q.q1 - 1.5 * (q.q3 - q.q1) THEN {x} END) AS whisker_low,
       MAX(CASE WHEN {x} <= q.q3 + 1.5 * (q.q3 - q.q1) THEN {x} END) AS whisker_high
FROM {src} d JOIN (SELECT {by}, CAST(COUNT(*) AS BIGINT) AS n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
                          quantile_cont({x}, 0.75) AS q3 FROM {src} WHERE {value} IS NOT NULL AND {where} GROUP BY {by}) q
  ON q.{by} = d.{by}
WHERE {value} IS NOT NULL AND {where} GROUP BY ALL"""


BOX_D = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@register("box_stats", sql_final(q(" UNION ALL ".join([
    _box_sql("auto_renew_pct", "is_churn", "ds"), _box_sql("cancel_rate", "is_churn", "ds"),
    _box_sql("total_revenue", "risk_tier", "vt", "has_transactions_data = 1")])), BOX_D))
def box_stats(spark, sf):
    """Box-plot statistics (quartiles, 1.5 IQR whiskers clamped to data)."""
    ch = Chain.shared(spark, sf)
    ds = ch.dataset()
    vt = ch.value_tiers().where(F.col("has_transactions_data") == 1)

    def one(df, value, by):
        return PR.box_stats(df, value, [by]).select(F.lit(value).alias("feature"), F.col(by).cast("string").alias("grp"),
                                                    "n", *BOX_D)
    return finalize(one(ds, "auto_renew_pct", "is_churn").unionByName(one(ds, "cancel_rate", "is_churn"))
                    .unionByName(one(vt, "total_revenue", "risk_tier")))


@register("category_share_and_rate", sql_final(q("SELECT AVG(CASE WHEN city = 1 THEN 1.0 ELSE 0.0 END) * 100.0 AS share_pct, "
                                                 "AVG(CASE WHEN city = 1 THEN CAST(is_churn AS DOUBLE) END) * 100.0 AS churn_rate_pct FROM ds"),
                                               ["share_pct", "churn_rate_pct"]))
def category_share_and_rate(spark, sf):
    """Share of city 1 and its churn rate."""
    return finalize(PR.category_share_and_rate(_ds(spark, sf), "city", 1))
