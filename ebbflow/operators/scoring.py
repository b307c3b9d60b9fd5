"""Deterministic scorecard, informative label, threshold sweep (H16), threshold
selection (F5), risk tiers (B16, H17), and the classification metrics that only
need conditional sums (H14, H15, D22, D30, D33, D34).

The scorecard stands in for a trained model wherever a query must be checkable
in SQL; every metric below takes the score column as a parameter, so the same
code runs on MLlib scores."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions.expr import clip_keep_null, hash_uniform, risk_tier, score_range_label


def scorecard_points(proxy: bool = False) -> Column:
    """Integer points (0..100).  Fixed values: no history -> 50; otherwise the
    capped sum of 35 (auto-renew off), recency >365 / >180 / >90 -> 40 / 25 / 10,
    15 (latest cancel), 10 (tenure < 180), 10 (cancel rate > 0.05) and
    max(0, 15 - total transactions).  The proxy-controlled card drops the two
    label-adjacent terms (recency and latest cancel)."""
    rec = F.col("days_since_last_txn")
    terms = [
        F.when(F.col("latest_is_auto_renew") == 0, 35).otherwise(0),
        F.when(F.coalesce(F.col("tenure_days_at_cutoff") < 180, F.lit(False)), 10).otherwise(0),
        F.when(F.coalesce(F.col("cancel_rate") > 0.05, F.lit(False)), 10).otherwise(0),
        F.greatest(F.lit(0), F.lit(15) - F.col("total_transactions")),
    ]
    if not proxy:
        terms += [
            F.when(rec > 365, 40).when(rec > 180, 25).when(rec > 90, 10).otherwise(0),
            F.when(F.col("latest_is_cancel") == 1, 15).otherwise(0),
        ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when(F.col("has_transactions_data") == 0, F.lit(50)).otherwise(F.least(F.lit(100), total)).cast("int")


def attach_scorecard(dataset: DataFrame) -> DataFrame:
    """Adds points, proxy points, both scores and the informative label B
    (``is_churn``; 1 when md5-uniform(msno||'|y') < points/110).  The behavioural
    label is kept as ``is_churn_behavioural``."""
    return (
        dataset.withColumnRenamed("is_churn", "is_churn_behavioural")
        .withColumn("points", scorecard_points(False))
        .withColumn("points_proxy", scorecard_points(True))
        .withColumn("risk_score_full", F.col("points") / F.lit(100.0))
        .withColumn("risk_score_proxy_controlled", F.col("points_proxy") / F.lit(100.0))
        .withColumn("is_churn", (hash_uniform(F.col("msno"), F.lit("|y")) < F.col("points") / F.lit(110.0)).cast("int"))
    )


def threshold_sweep(df: DataFrame, score: str = "risk_score_full", label: str = "is_churn",
                    grid: list[float] | None = None) -> DataFrame:
    """Precision, recall, F1, % and n targeted (``score >= t``) for each grid
    threshold.  ONE pass: two conditional counts per threshold in a single
    partial + final hash aggregate (explicit ``>=`` so float edges agree with the
    rule), then the one-row result is exploded into the grid rows - the input is
    never exploded per threshold and no join or window is needed."""
    grid = grid or C.THRESHOLD_GRID
    p = F.col(score)
    y = F.col(label) == 1
    aggs = [F.count(F.lit(1)).alias("N"), F.count_if(y).alias("P")]
    for k, t in enumerate(grid):
        hit = p >= F.lit(float(t))
        aggs += [F.count_if(hit).alias(f"n{k}"), F.count_if(hit & y).alias(f"tp{k}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n_targeted"),
                              F.col(f"tp{k}").alias("tp")) for k, t in enumerate(grid)])
    out = one.select("N", "P", F.explode(rows).alias("r")).select("N", "P", "r.*")
    prec = F.when(F.col("n_targeted") > 0, F.col("tp") / F.col("n_targeted")).otherwise(0.0)
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    f1 = F.when(F.col("n_targeted") + F.col("P") > 0,
                2.0 * F.col("tp") / (F.col("n_targeted") + F.col("P"))).otherwise(0.0)
    return out.select(
        "threshold", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
        (F.col("n_targeted") / F.col("N") * 100.0).alias("pct_targeted"),
        F.col("n_targeted").cast("bigint").alias("n_targeted"),
    )


def select_thresholds(sweep: DataFrame, target: float = C.PRECISION_TARGET_HIGH) -> DataFrame:
    """F5 on the sweep (<= 19 rows): High = lowest threshold reaching the
    precision target, else the (first) highest-precision threshold; Medium = the
    first F1-maximising threshold; if High <= Medium, High = min(top of grid,
    Medium + 0.10)."""
    agg = sweep.agg(
        F.min(F.when(F.col("precision") >= F.lit(target), F.col("threshold"))).alias("hit"),
        F.max_by("threshold", F.struct(F.col("precision"), -F.col("threshold"))).alias("best_prec"),
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("medium_threshold"),
        F.max("threshold").alias("top"),
    )
    high0 = F.coalesce(F.col("hit"), F.col("best_prec"))
    high = F.when(high0 <= F.col("medium_threshold"),
                  F.least(F.col("top"), F.round(F.col("medium_threshold") + F.lit(C.HIGH_REPAIR_STEP), 2))
                  ).otherwise(high0)
    return agg.select(high.alias("high_risk_threshold"), F.col("medium_threshold").alias("medium_risk_threshold"))


def collect_thresholds(sweep: DataFrame) -> tuple[float, float]:
    """Fixed-size result (one row) brought to the driver: (medium, high)."""
    row = select_thresholds(sweep).first()
    return float(row["medium_risk_threshold"]), float(row["high_risk_threshold"])


def assign_tiers(df: DataFrame, medium: float, high: float, score: str = "risk_score_full") -> DataFrame:
    return df.withColumn("risk_tier", risk_tier(score, medium, high))


def risk_tier_table(scored: DataFrame, medium: float, high: float, score: str = "risk_score_full",
                    label: str = "is_churn") -> DataFrame:
    """N, % of base and observed churn per tier, with the score range label.
    One aggregation; the three tier rows are always present."""
    spark = scored.sparkSession
    tiers = small_frame(spark,
        [("High", float(high), 1.0001, 1), ("Medium", float(medium), float(high), 2), ("Low", 0.0, float(medium), 3)],
        "tier string, lo double, hi double, tier_order int")
    per = scored.groupBy(risk_tier(score, medium, high).alias("tier")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg(F.col(label).cast("double")).alias("rate"))
    # three rows after the aggregate: the whole-frame window total is bounded
    return (tiers.join(per, "tier", "left")
            .withColumn("N", F.sum(F.coalesce("n_customers", F.lit(0))).over(Window.partitionBy()))
            .select("tier", "tier_order", score_range_label("lo", "hi").alias("score_range"),
                    F.coalesce("n_customers", F.lit(0)).cast("bigint").alias("n_customers"),
                    (F.coalesce("n_customers", F.lit(0)) / F.col("N") * 100.0).alias("pct_of_base"),
                    (F.col("rate") * 100.0).alias("observed_churn_rate_in_tier")))


def classification_metrics(df: DataFrame, score: str, label: str = "is_churn", threshold: float = 0.5,
                           eps: float = 1e-15) -> DataFrame:
    """Confusion counts, precision, recall, F1, log loss (clipped)
    and Brier score in one pass."""
    p = F.col(score).cast("double")
    y = F.col(label).cast("double")
    pred = p >= F.lit(threshold)
    pc = clip_keep_null(p, eps, 1 - eps)
    agg = df.agg(
        F.count_if(pred & (y == 1)).alias("tp"), F.count_if(pred & (y == 0)).alias("fp"),
        F.count_if(~pred & (y == 1)).alias("fn"), F.count_if(~pred & (y == 0)).alias("tn"),
        F.avg(-(y * F.ln(pc) + (1 - y) * F.ln(1 - pc))).alias("log_loss"),
        F.avg(F.pow(p - y, 2)).alias("brier"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        "tp", "fp", "fn", "tn",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        "log_loss", "brier")


def threshold_sensitivity(sweep: DataFrame, targets: list[float]) -> DataFrame:
    """For each precision target, the High threshold the F5 rule would pick
    (lowest threshold reaching it, else the first highest-precision one) and the
    share targeted there.  ``targets`` x sweep is at most 7 x 19 rows."""
    spark = sweep.sparkSession
    t = small_frame(spark, [(float(x),) for x in targets], "precision_target double")
    fallback = sweep.agg(F.max_by("threshold", F.struct(F.col("precision"), -F.col("threshold"))).alias("fb")).first()["fb"]
    hit = (t.join(sweep, sweep["precision"] >= t["precision_target"], "left")
           .groupBy("precision_target").agg(F.min("threshold").alias("hit")))
    chosen = hit.select("precision_target", F.coalesce("hit", F.lit(fallback)).alias("resulting_high_threshold"))
    return chosen.join(sweep.select(F.col("threshold").alias("resulting_high_threshold"),
                                    F.col("pct_targeted").alias("pct_targeted_at_that_threshold")),
                       "resulting_high_threshold", "left").select(
        "precision_target", "resulting_high_threshold", "pct_targeted_at_that_threshold")
