"""Registered queries: scores, threshold sweep and selection, tiers, classification
and ranking metrics, bootstrap (B16, B22, B28, B36, A6, D22, D30, D33, F5, H12-H18, H24, H25, H27, H30)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions import expr as X
from ebbflow.operators import curves as CU
from ebbflow.operators import scoring as SC
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import hash_u, q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.registry import register

SWEEP_D = ["threshold", "precision", "recall", "f1", "pct_targeted"]


@register("scorecard", q("SELECT msno, points, points_proxy, risk_score_full, risk_score_proxy_controlled, is_churn, "
                         "is_churn_behavioural FROM sc"))
def scorecard(spark, sf):
    """Scorecard points, both scores, informative label B and behavioural label A."""
    return Chain.shared(spark, sf).scored().select("msno", "points", "points_proxy", "risk_score_full",
                                            "risk_score_proxy_controlled", "is_churn", "is_churn_behavioural")


@register("threshold_sweep", sql_final(q("SELECT * FROM sweep"), SWEEP_D))
def threshold_sweep(spark, sf):
    """19-threshold sweep from one bucket aggregation."""
    return finalize(Chain.shared(spark, sf).sweep())


@register("threshold_sweep_proxy", sql_final(q("""
SELECT g.threshold,
       CASE WHEN SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) > 0
            THEN SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END)
                 / SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) ELSE 0.0 END AS precision,
       SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END) / SUM(s.is_churn) AS recall,
       2.0 * SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END)
           / (SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) + SUM(s.is_churn)) AS f1,
       SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) * 100.0 / COUNT(*) AS pct_targeted,
       CAST(SUM(CASE WHEN s.risk_score_proxy_controlled >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_targeted
FROM grid g CROSS JOIN sc s GROUP BY g.threshold"""), SWEEP_D))
def threshold_sweep_proxy(spark, sf):
    """H16 on the proxy-controlled score."""
    return finalize(Chain.shared(spark, sf).sweep("risk_score_proxy_controlled"))


@register("select_thresholds", q("SELECT high AS high_risk_threshold, medium AS medium_risk_threshold FROM th"))
def select_thresholds(spark, sf):
    """High / Medium thresholds chosen from the sweep."""
    return SC.select_thresholds(Chain.shared(spark, sf).sweep())


@register("assign_risk_tier", q("SELECT msno, is_churn, risk_score_full, risk_score_proxy_controlled, risk_tier FROM pred"))
def assign_risk_tier(spark, sf):
    """risk_scoring_predictions (key, label, two scores, tier)."""
    return Chain.shared(spark, sf).predictions().select("msno", "is_churn", "risk_score_full",
                                                 "risk_score_proxy_controlled", "risk_tier")


RTT_SQL = """
SELECT t.tier, t.tier_order,
       CASE WHEN t.hi < 1.01 THEN '[' || printf('%.2f', t.lo) || ', ' || printf('%.2f', t.hi) || ')'
            ELSE '[' || printf('%.2f', t.lo) || ', 1.00]' END AS score_range,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n_customers,
       COALESCE(c.n, 0) * 100.0 / (SELECT COUNT(*) FROM pred) AS pct_of_base,
       c.rate * 100.0 AS observed_churn_rate_in_tier
FROM (SELECT 'High' AS tier, 1 AS tier_order, high AS lo, 1.0001 AS hi FROM th
      UNION ALL SELECT 'Medium', 2, medium, high FROM th
      UNION ALL SELECT 'Low', 3, 0.0, medium FROM th) t
LEFT JOIN (SELECT risk_tier, COUNT(*) AS n, AVG(is_churn) AS rate FROM pred GROUP BY risk_tier) c ON c.risk_tier = t.tier"""


@register("risk_tier_table", sql_final(q(RTT_SQL), ["pct_of_base", "observed_churn_rate_in_tier"]))
def risk_tier_table(spark, sf):
    """Per tier n, % of base, observed churn and the score range label."""
    ch = Chain.shared(spark, sf)
    medium, high = ch.thresholds
    return finalize(SC.risk_tier_table(ch.scored(), medium, high))


@register("score_range_label", q(f"SELECT tier, score_range FROM ({RTT_SQL}) x"))
def score_range_label(spark, sf):
    """B36: "[lo, hi)" / "[lo, 1.00]" labels of the three tiers."""
    ch = Chain.shared(spark, sf)
    medium, high = ch.thresholds
    return SC.risk_tier_table(ch.scored(), medium, high).select("tier", "score_range")


def _cls_sql(score, thr):
    return f"""
SELECT '{score}' AS score_column, CAST({thr} AS DOUBLE) AS threshold,
       CAST(SUM(CASE WHEN {score} >= {thr} AND is_churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(SUM(CASE WHEN {score} >= {thr} AND is_churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN {score} < {thr} AND is_churn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN {score} < {thr} AND is_churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       AVG(-(is_churn * ln(greatest(1e-15, least(1 - 1e-15, {score})))
             + (1 - is_churn) * ln(1 - greatest(1e-15, least(1 - 1e-15, {score}))))) AS log_loss,
       AVG(({score} - is_churn) * ({score} - is_churn)) AS brier
FROM pred"""


CLS_D = ["threshold", "precision", "recall", "f1", "log_loss", "brier"]


def _cls_sql_both(thr):
    return f"""
SELECT score_column, threshold, tp, fp, fn, tn,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, log_loss, brier
FROM ({_cls_sql('risk_score_full', thr)} UNION ALL {_cls_sql('risk_score_proxy_controlled', thr)}) x"""


CLS_SQL = _cls_sql_both(0.5)


def _cls(scored, score, thr):
    return SC.classification_metrics(scored, score, "is_churn", thr).select(
        F.lit(score).alias("score_column"), F.lit(float(thr)).alias("threshold"), "*")


@register("classification_metrics", sql_final(q(CLS_SQL), CLS_D))
def classification_metrics(spark, sf):
    """H14 + H15: confusion counts, precision, recall, F1, log loss, Brier at 0.5 for both scores."""
    s = Chain.shared(spark, sf).scored()
    return finalize(_cls(s, "risk_score_full", 0.5).unionByName(_cls(s, "risk_score_proxy_controlled", 0.5)))


@register("brier_score", sql_final(q("SELECT AVG((risk_score_full - is_churn) * (risk_score_full - is_churn)) AS brier_full, "
                                     "AVG((risk_score_proxy_controlled - is_churn) * (risk_score_proxy_controlled - is_churn)) "
                                     "AS brier_proxy_controlled FROM sc"), ["brier_full", "brier_proxy_controlled"]))
def brier_score(spark, sf):
    """Mean squared error of the (clipped) score against the label."""
    s = Chain.shared(spark, sf).scored()
    y = F.col("is_churn").cast("double")
    return finalize(s.agg(F.avg(F.pow(X.score_clip("risk_score_full") - y, 2)).alias("brier_full"),
                          F.avg(F.pow(X.score_clip("risk_score_proxy_controlled") - y, 2)).alias("brier_proxy_controlled")))


@register("score_clip", q("SELECT msno, greatest(0.0, least(1.0, (points - 20) / 60.0)) AS clipped FROM sc"))
def score_clip(spark, sf):
    """A stretched score clipped to [0, 1] before Brier (a missing score stays missing)."""
    s = Chain.shared(spark, sf).scored()
    return finalize(s.select("msno", X.score_clip((F.col("points") - 20) / 60.0).alias("clipped")))


@register("confusion_group", q("SELECT msno, is_churn, risk_score_full, CASE WHEN risk_score_full >= 0.65 AND is_churn = 1 THEN 'TP' "
                               "WHEN risk_score_full >= 0.65 THEN 'FP' WHEN is_churn = 1 THEN 'FN' ELSE 'TN' END AS confusion_group FROM sc"))
def confusion_group(spark, sf):
    """TP / FP / FN / TN at 0.65 per customer."""
    s = Chain.shared(spark, sf).scored()
    return s.select("msno", "is_churn", "risk_score_full",
                    X.confusion_group("risk_score_full", "is_churn").alias("confusion_group"))


CM_SQL = f"SELECT * EXCLUDE (score_column, log_loss, brier) FROM ({_cls_sql_both(0.65)}) y WHERE score_column = 'risk_score_full'"


@register("confusion_matrix", sql_final(q(CM_SQL), ["threshold", "precision", "recall", "f1"]))
def confusion_matrix(spark, sf):
    """2 x 2 counts and precision / recall at 0.65."""
    s = Chain.shared(spark, sf).scored()
    return finalize(_cls(s, "risk_score_full", 0.65).drop("score_column", "log_loss", "brier"))


@register("class_weight_ratio", sql_final(q("SELECT CAST(SUM(1 - is_churn) AS BIGINT) AS n_negative, CAST(SUM(is_churn) AS BIGINT) AS n_positive, "
                                            "SUM(1 - is_churn) * 1.0 / SUM(is_churn) AS neg_pos_ratio FROM sc"), ["neg_pos_ratio"]))
def class_weight_ratio(spark, sf):
    """Negatives / positives (the boosted-tree positive weight)."""
    s = Chain.shared(spark, sf).scored()
    return finalize(s.agg(F.sum(1 - F.col("is_churn")).cast("bigint").alias("n_negative"),
                          F.sum("is_churn").cast("bigint").alias("n_positive"))
                    .withColumn("neg_pos_ratio", F.col("n_negative") / F.col("n_positive")))


@register("class_weights", sql_final(q("SELECT msno, is_churn, CASE WHEN is_churn = 1 THEN COUNT(*) OVER () / (2.0 * SUM(is_churn) OVER ()) "
                                       "ELSE COUNT(*) OVER () / (2.0 * SUM(1 - is_churn) OVER ()) END AS class_weight FROM sc"), ["class_weight"]))
def class_weights(spark, sf):
    """Balanced weights n / (2 n_class) as a column (class counts are two scalars)."""
    from ebbflow.operators import ml
    return finalize(ml.with_balanced_weights(Chain.shared(spark, sf).scored()).select("msno", "is_churn", "class_weight"))


@register("tier_lift", sql_final(q("""
SELECT risk_tier, AVG(is_churn) AS churn_rate, (SELECT AVG(is_churn) FROM pred) AS base_rate,
       AVG(is_churn) / (SELECT AVG(is_churn) FROM pred) AS lift_vs_base
FROM pred GROUP BY risk_tier"""), ["churn_rate", "base_rate", "lift_vs_base"]))
def tier_lift(spark, sf):
    """Tier churn rate over the base rate."""
    p = Chain.shared(spark, sf).predictions()
    g = p.groupBy("risk_tier").agg(F.avg("is_churn").alias("churn_rate"), F.count(F.lit(1)).alias("n"),
                                   F.sum("is_churn").alias("pos"))
    whole = Window.partitionBy()  # three rows
    base = F.sum("pos").over(whole) / F.sum("n").over(whole)
    return finalize(g.select("risk_tier", "churn_rate", base.alias("base_rate"),
                             (F.col("churn_rate") / base).alias("lift_vs_base")))


@register("sweep_lift", sql_final(q("SELECT threshold, precision, precision / (SELECT AVG(is_churn) FROM sc) AS churn_lift FROM sweep"),
                                  ["threshold", "precision", "churn_lift"]))
def sweep_lift(spark, sf):
    """Sweep precision over the base rate."""
    ch = Chain.shared(spark, sf)
    base = ch.scored().agg(F.avg("is_churn")).first()[0]  # one scalar
    return finalize(ch.sweep().select("threshold", "precision", (F.col("precision") / F.lit(base)).alias("churn_lift")))


TARGETS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.70, 0.85]  # fixed values: sensitivity targets


@register("threshold_sensitivity", sql_final(q(f"""
SELECT t.precision_target,
       COALESCE((SELECT MIN(threshold) FROM sweep WHERE precision >= t.precision_target),
                (SELECT threshold FROM sweep ORDER BY precision DESC, threshold LIMIT 1)) AS resulting_high_threshold,
       (SELECT pct_targeted FROM sweep s2 WHERE s2.threshold = COALESCE(
            (SELECT MIN(threshold) FROM sweep WHERE precision >= t.precision_target),
            (SELECT threshold FROM sweep ORDER BY precision DESC, threshold LIMIT 1))) AS pct_targeted_at_that_threshold
FROM (SELECT * FROM (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in TARGETS)}) v(precision_target)) t"""),
    ["precision_target", "resulting_high_threshold", "pct_targeted_at_that_threshold"]))
def threshold_sensitivity(spark, sf):
    """The High threshold each precision target would pick (7 targets x 19-row sweep)."""
    sweep = Chain.shared(spark, sf).sweep()
    return finalize(SC.threshold_sensitivity(sweep, TARGETS))


@register("f1_band", sql_final(q("SELECT MIN(f1) AS f1_min, MAX(f1) AS f1_max, MAX(f1) - MIN(f1) AS f1_range, "
                                 "(MAX(f1) - MIN(f1)) / MAX(f1) * 100.0 AS relative_spread_pct FROM sweep "
                                 "WHERE threshold >= 0.55 AND threshold <= 0.85"),
                                 ["f1_min", "f1_max", "f1_range", "relative_spread_pct"]))
def f1_band(spark, sf):
    """F1 spread over thresholds 0.55-0.85."""
    s = Chain.shared(spark, sf).sweep().where((F.col("threshold") >= 0.55) & (F.col("threshold") <= 0.85))
    return finalize(s.agg(F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"))
                    .withColumn("f1_range", F.col("f1_max") - F.col("f1_min"))
                    .withColumn("relative_spread_pct", F.col("f1_range") / F.col("f1_max") * 100.0))


def _rank_sql(score, label="is_churn", src="sc"):
    return f"""
SELECT '{score}' AS score_column, SUM(pos * tp / (tp + fp)) / MAX(P) AS pr_auc,
       SUM(neg * (tp - pos / 2.0)) / (MAX(P) * MAX(N)) AS roc_auc
FROM (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
      FROM (SELECT CAST({score} AS DOUBLE) AS score, SUM({label}) * 1.0 AS pos, SUM(1 - {label}) * 1.0 AS neg
            FROM {src} GROUP BY 1) b) c"""


@register("ranking_metrics", sql_final(q(f"{_rank_sql('risk_score_full')} UNION ALL {_rank_sql('risk_score_proxy_controlled')}"),
                                       ["pr_auc", "roc_auc"]))
def ranking_metrics(spark, sf):
    """H12 + H13: ROC-AUC (mid-rank ties) and average precision for both scores."""
    s = Chain.shared(spark, sf).scored()
    parts = [CU.ranking_metrics(s, c).select(F.lit(c).alias("score_column"), "pr_auc", "roc_auc")
             for c in ["risk_score_full", "risk_score_proxy_controlled"]]
    return finalize(parts[0].unionByName(parts[1]))


CURVE_D = ["score", "pos", "neg", "tp", "fp", "precision", "recall", "fpr"]


@register("curve_points", sql_final(q("""
SELECT score, pos, neg, tp, fp, P, N, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       tp / P AS recall, fp / N AS fpr
FROM (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
      FROM (SELECT risk_score_full AS score, CAST(SUM(is_churn) AS DOUBLE) AS pos, CAST(SUM(1 - is_churn) AS DOUBLE) AS neg
            FROM sc GROUP BY 1) b) c"""), CURVE_D + ["P", "N"]))
def curve_points(spark, sf):
    """ROC and PR points at every distinct score."""
    return finalize(CU.curve(Chain.shared(spark, sf).scored(), "risk_score_full"))


@register("precision_recall_at_k", sql_final(q("""
, blocks AS (SELECT risk_score_full AS score, SUM(is_churn) * 1.0 AS pos, COUNT(*) * 1.0 AS n FROM sc GROUP BY 1),
cum AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
               SUM(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM blocks),
k AS (SELECT COUNT(*) AS k FROM pred WHERE risk_tier = 'High')
SELECT CAST(k.k AS BIGINT) AS k, score AS cutoff_score,
       ((cpos - pos) + (k.k - (cn - n)) * pos / n) / k.k AS precision_at_k,
       ((cpos - pos) + (k.k - (cn - n)) * pos / n) / (SELECT SUM(is_churn) FROM sc) AS recall_at_k
FROM cum CROSS JOIN k WHERE cn - n < k.k AND cn >= k.k"""), ["cutoff_score", "precision_at_k", "recall_at_k"]))
def precision_recall_at_k(spark, sf):
    """Precision / recall in the top k = High-tier size, tie block pro rata."""
    ch = Chain.shared(spark, sf)
    k = ch.predictions().where(F.col("risk_tier") == "High").count()  # one scalar
    return finalize(CU.precision_recall_at_k(ch.scored(), "risk_score_full", k))


BOOT_N = 500


def _boot_sql(n_boot=BOOT_N):
    """The same draws by the same rule, spelled for DuckDB: a table of distribution functions for
    small cells, and every attempt of the rejection draw at once (the first accepted counts)."""
    def part(digest, at):
        return f"CAST(('0x' || substr({digest}, {at}, 8)) AS BIGINT)"
    tables = ", ".join("[" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in CU._poisson_cdf(m)) + "]" for m in range(1, CU.TABLE_MEAN + 1))
    return f"""
, cells AS (SELECT is_churn AS y, risk_score_full AS s_full, risk_score_proxy_controlled AS s_proxy, COUNT(*) AS n FROM sc GROUP BY ALL),
reps AS (SELECT c.*, CAST(n AS DOUBLE) AS lam, r.b, printf('%d|%.15f|%.15f', CAST(y AS INTEGER), s_full, s_proxy) || 'boot' || CAST(r.b AS VARCHAR) AS t
         FROM cells c CROSS JOIN range(1, {n_boot + 1}) r(b)),
tries AS (SELECT *, 0.931 + 2.53 * sqrt(lam) AS bb, -0.059 + 0.02483 * (0.931 + 2.53 * sqrt(lam)) AS aa,
                 ({part('h', 1)} + 0.5) / 4294967296.0 - 0.5 AS u, ({part('h', 9)} + 1.0) / 4294967296.0 AS v
          FROM (SELECT r.*, j, md5(t || ':' || CAST(j AS VARCHAR)) AS h FROM reps r CROSS JOIN range(1, {CU.ATTEMPTS + 1}) x(j) WHERE n > {CU.TABLE_MEAN})),
ks AS (SELECT *, 0.5 - abs(u) AS us, floor((2.0 * aa / (0.5 - abs(u)) + bb) * u + lam + 0.43) AS k FROM tries),
ok AS (SELECT *, CASE WHEN k < 0 THEN 0 ELSE lgamma(k + 1) END AS lk FROM ks),
hit AS (SELECT t, arg_min(k, j) AS w FROM ok
        WHERE (us >= 0.07 AND v <= 0.9277 - 3.6224 / (bb - 2.0))
           OR (k >= 0 AND (us >= 0.013 OR v <= us)
               AND ln(v) + ln(1.1239 + 1.1328 / (bb - 3.4)) - ln(aa / (us * us) + bb) <= -lam + k * ln(lam) - lk) GROUP BY t),
wts AS (SELECT r.*, CASE WHEN r.n <= {CU.TABLE_MEAN} THEN CAST(len(list_filter([{tables}][CAST(least(r.n, {CU.TABLE_MEAN}) AS INTEGER)],
                     lambda c: c <= {hash_u("r.t || ':0'")})) AS DOUBLE) ELSE coalesce(hit.w, r.lam) END AS w
        FROM reps r LEFT JOIN hit ON hit.t = r.t),
longs AS (SELECT b, y, w, 'full' AS model, s_full AS score FROM wts UNION ALL SELECT b, y, w, 'proxy', s_proxy FROM wts),
blocks AS (SELECT b, model, score, SUM(w * y) AS pos, SUM(w * (1 - y)) AS neg FROM longs GROUP BY ALL),
cum AS (SELECT *, SUM(pos) OVER (PARTITION BY b, model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               SUM(neg) OVER (PARTITION BY b, model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               SUM(pos) OVER (PARTITION BY b, model) AS P FROM blocks),
ap AS (SELECT b, model, SUM(pos * CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) / MAX(P) AS ap FROM cum GROUP BY b, model),
diffs AS (SELECT m.b, m.ap - r.ap AS d FROM ap m JOIN ap r ON m.b = r.b AND r.model = 'full' WHERE m.model = 'proxy'),
obs AS (SELECT (SELECT pr_auc FROM ({_rank_sql('risk_score_proxy_controlled')})) - (SELECT pr_auc FROM ({_rank_sql('risk_score_full')})) AS od)
SELECT 'proxy' AS model, (SELECT od FROM obs) AS observed_diff, quantile_cont(d, 0.025) AS ci95_low,
       quantile_cont(d, 0.975) AS ci95_high, CAST(COUNT(*) AS BIGINT) AS n_boot FROM diffs"""


@register("bootstrap_pr_auc", sql_final(q(_boot_sql()), ["observed_diff", "ci95_low", "ci95_high"]))
def bootstrap_pr_auc(spark, sf):
    """Paired Poisson bootstrap (500 replicates) of PR-AUC(proxy) - PR-AUC(full)."""
    s = Chain.shared(spark, sf).scored()
    return finalize(CU.bootstrap_pr_auc(s, {"full": "risk_score_full", "proxy": "risk_score_proxy_controlled"}, "full", BOOT_N))


@register("risk_summary_json", sql_final(q(f"""
SELECT CAST((SELECT COUNT(*) FROM sc) AS BIGINT) AS n_customers_scored, (SELECT AVG(is_churn) FROM sc) AS actual_churn_rate,
       (SELECT pr_auc FROM ({_rank_sql('risk_score_full')})) AS pr_auc_full,
       (SELECT pr_auc FROM ({_rank_sql('risk_score_proxy_controlled')})) AS pr_auc_proxy_controlled,
       (SELECT AVG((risk_score_full - is_churn) ^ 2) FROM sc) AS brier_score_full,
       (SELECT AVG((risk_score_proxy_controlled - is_churn) ^ 2) FROM sc) AS brier_score_proxy_controlled,
       (SELECT high FROM th) AS high_risk_threshold, (SELECT medium FROM th) AS medium_risk_threshold,
       r.tier, r.score_range, r.n_customers, r.pct_of_base, r.observed_churn_rate_in_tier
FROM ({RTT_SQL}) r"""), ["actual_churn_rate", "pr_auc_full", "pr_auc_proxy_controlled", "brier_score_full",
                         "brier_score_proxy_controlled", "pct_of_base", "observed_churn_rate_in_tier"]))
def risk_summary_json(spark, sf):
    """The nested summary document (scalars, thresholds struct, tiers array),
    flattened to one row per tier for comparison; ``summary_document`` builds the
    nested row itself."""
    from ebbflow.operators import summary
    doc = summary.risk_summary_document(Chain.shared(spark, sf))
    return finalize(summary.flatten_risk_summary(doc))
