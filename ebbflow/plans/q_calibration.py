"""Registered queries: calibration split, Platt / isotonic fits, winner, calibrated
probabilities, reliability bins and calibrated-scale checks (C8, E5, H19-H23, D29, D34, D43)."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow.operators import calibration as CA
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import q, qc
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.registry import register


@register("split_flag_semi", q(", cs AS (SELECT msno, CASE WHEN ('0x' || substr(md5(msno || 'calib'), 1, 8))::BIGINT / 4294967296.0 < 0.5 "
                               "THEN 'calib_fit' ELSE 'calib_eval' END AS calib_split FROM pred)\n"
                               "SELECT p.msno, CASE WHEN f.msno IS NOT NULL THEN 'calib_fit' ELSE 'calib_eval' END AS calib_split "
                               "FROM pred p LEFT JOIN (SELECT msno FROM cs WHERE calib_split = 'calib_fit') f ON f.msno = p.msno"))
def split_flag_semi(spark, sf):
    """Membership of the fit subset as a label (left join on the subset's keys)."""
    ch = Chain.shared(spark, sf)
    fit_keys = ch.calib_split.where(F.col("calib_split") == CA.FIT).select("msno").withColumn("_in", F.lit(1))
    return ch.predictions().select("msno").join(fit_keys, "msno", "left").select(
        "msno", F.when(F.col("_in").isNotNull(), CA.FIT).otherwise(CA.EVAL).alias("calib_split"))


@register("platt_calibration", sql_final(qc("SELECT 'full' AS model, w, b FROM platt_full UNION ALL "
                                            "SELECT 'proxy_controlled', w, b FROM platt_proxy_controlled"), ["w", "b"]))
def platt_calibration(spark, sf):
    """1-feature logistic (C = 1) fitted on the fit half, per model."""
    ch = Chain.shared(spark, sf)
    rows = [(m, float(c.w), float(c.b)) for m, c in ch.calibrators.items()]
    return finalize(small_frame(spark, rows, "model string, w double, b double"))


@register("isotonic_calibration", sql_final(qc("SELECT 'full' AS model, x, fit FROM iso_full UNION ALL "
                                               "SELECT 'proxy_controlled', x, fit FROM iso_proxy_controlled"), ["x", "fit"]))
def isotonic_calibration(spark, sf):
    """The isotonic fit evaluated at every distinct fit-half score."""
    ch = Chain.shared(spark, sf)
    parts = []
    for m, cal in ch.calibrators.items():
        fit = ch.calib_split.where(F.col("calib_split") == CA.FIT)
        xs = fit.select(F.col(cal.score).cast("double").alias("x")).distinct()
        parts.append(CA.apply_isotonic(cal.iso, xs.withColumn(cal.score, F.col("x")), cal.score, "fit")
                     .select(F.lit(m).alias("model"), "x", "fit"))
    return finalize(parts[0].unionByName(parts[1]))


@register("calibration_comparison", sql_final(qc("SELECT model, 'raw' AS method, raw AS brier_score, CAST(n_eval AS BIGINT) AS n_eval FROM cmp_full "
                                                 "UNION ALL SELECT model, 'sigmoid', sigmoid, n_eval FROM cmp_full "
                                                 "UNION ALL SELECT model, 'isotonic', isotonic, n_eval FROM cmp_full "
                                                 "UNION ALL SELECT model, 'raw', raw, n_eval FROM cmp_proxy_controlled "
                                                 "UNION ALL SELECT model, 'sigmoid', sigmoid, n_eval FROM cmp_proxy_controlled "
                                                 "UNION ALL SELECT model, 'isotonic', isotonic, n_eval FROM cmp_proxy_controlled"),
                                              ["brier_score"]))
def calibration_comparison(spark, sf):
    """H22 input: eval-half Brier of raw, sigmoid and isotonic per model."""
    return finalize(Chain.shared(spark, sf).calibration_comparison())


def _win_sql(m):
    return (f"SELECT model, CASE WHEN isotonic < sigmoid THEN 'isotonic' ELSE 'sigmoid' END AS winner, "
            f"least(isotonic, sigmoid) AS winner_brier, raw AS raw_brier, (1 - least(isotonic, sigmoid) / raw) * 100.0 AS pct_improvement "
            f"FROM cmp_{m}")


@register("calibration_winner", sql_final(qc(f"{_win_sql('full')} UNION ALL {_win_sql('proxy_controlled')}"),
                                          ["winner_brier", "raw_brier", "pct_improvement"]))
def calibration_winner(spark, sf):
    """Lowest eval Brier among calibrated methods, improvement over raw."""
    return finalize(CA.pick_winner(Chain.shared(spark, sf).calibration_comparison()))


CAL_COLS = ["msno", "is_churn", "risk_tier", "calib_split", "risk_score_full", "calibrated_probability",
            "risk_score_proxy_controlled", "calibrated_probability_proxy_controlled"]


@register("calibrated_probabilities", sql_final(qc("SELECT " + ", ".join(CAL_COLS) + " FROM cal"),
                                                ["calibrated_probability", "calibrated_probability_proxy_controlled"]))
def calibrated_probabilities(spark, sf):
    """Winners applied to every customer; raw scores kept."""
    return finalize(Chain.shared(spark, sf).calibrated().select(*CAL_COLS))


def _rel_sql(score, src):
    edges = ", ".join(f"quantile_cont({score}, {k / 10}) AS e{k}" for k in range(1, 10))
    binexpr = " + ".join(f"CASE WHEN {score} > e{k} THEN 1 ELSE 0 END" for k in range(1, 10))
    return (f", ed AS (SELECT {edges} FROM {src})\nSELECT CAST({binexpr} AS INTEGER) AS bin, CAST(COUNT(*) AS BIGINT) AS n, "
            f"AVG({score}) AS mean_predicted, AVG(is_churn) AS observed_rate FROM {src} CROSS JOIN ed GROUP BY 1")


@register("reliability_table", sql_final(q(_rel_sql("risk_score_full", "sc")), ["mean_predicted", "observed_rate"]))
def reliability_table(spark, sf):
    """H19 + E5: mean predicted vs observed rate per quantile bin of the raw score."""
    return finalize(CA.reliability_table(Chain.shared(spark, sf).scored(), "risk_score_full"))


@register("reliability_calibrated", sql_final(qc(_rel_sql("calibrated_probability", "cal")), ["mean_predicted", "observed_rate"]))
def reliability_calibrated(spark, sf):
    """H19 on the calibrated probability."""
    return finalize(CA.reliability_table(Chain.shared(spark, sf).calibrated(), "calibrated_probability"))


@register("quantile_bins", qc(", ed AS (SELECT " + ", ".join(f"quantile_cont(risk_score_full, {k / 10}) AS e{k}" for k in range(1, 10))
                              + " FROM sc)\nSELECT msno, CAST(" + " + ".join(f"CASE WHEN risk_score_full > e{k} THEN 1 ELSE 0 END" for k in range(1, 10))
                              + " AS INTEGER) AS bin FROM sc CROSS JOIN ed"))
def quantile_bins(spark, sf):
    """E5: decile bin of each customer's raw score (linear quantile edges, left search)."""
    s = Chain.shared(spark, sf).scored()
    edges = RA.quantile_row(s, {"e": ("risk_score_full", [k / 10 for k in range(1, 10)])})["e"]
    return s.select("msno", CA.quantile_bin(F.col("risk_score_full"), [float(e) for e in edges]).alias("bin"))


@register("calibrated_by_tier", sql_final(qc("SELECT risk_tier, AVG(calibrated_probability) AS mean, median(calibrated_probability) AS median, "
                                             "MIN(calibrated_probability) AS min, MAX(calibrated_probability) AS max FROM cal GROUP BY risk_tier"),
                                          ["mean", "median", "min", "max"]))
def calibrated_by_tier(spark, sf):
    """Calibrated probability distribution within each raw-score tier."""
    c = Chain.shared(spark, sf).calibrated()
    p = F.col("calibrated_probability")
    agg = c.groupBy("risk_tier").agg(F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"))
    return finalize(RA.with_quantiles(agg, c, ["risk_tier"], {"median": (p, 0.5)}).select("risk_tier", "mean", "median", "min", "max"))


@register("threshold_exceedance", qc("SELECT CAST(COUNT(*) FILTER (WHERE risk_score_full >= 0.65) AS BIGINT) AS n_raw_ge_65, "
                                     "CAST(COUNT(*) FILTER (WHERE calibrated_probability >= 0.65) AS BIGINT) AS n_calib_ge_65, "
                                     "CAST(COUNT(*) FILTER (WHERE risk_score_full >= 0.95) AS BIGINT) AS n_raw_ge_95, "
                                     "CAST(COUNT(*) FILTER (WHERE calibrated_probability >= 0.95) AS BIGINT) AS n_calib_ge_95, "
                                     "CAST(COUNT(*) AS BIGINT) AS n FROM cal"))
def threshold_exceedance(spark, sf):
    """How many customers pass 0.65 / 0.95 on the raw vs calibrated scale."""
    c = Chain.shared(spark, sf).calibrated()
    return c.agg(F.count_if(F.col("risk_score_full") >= 0.65).alias("n_raw_ge_65"),
                  F.count_if(F.col("calibrated_probability") >= 0.65).alias("n_calib_ge_65"),
                  F.count_if(F.col("risk_score_full") >= 0.95).alias("n_raw_ge_95"),
                  F.count_if(F.col("calibrated_probability") >= 0.95).alias("n_calib_ge_95"),
                  F.count(F.lit(1)).alias("n"))


@register("calibration_centering", sql_final(qc("SELECT AVG(risk_score_full) AS mean_raw, AVG(calibrated_probability) AS mean_calibrated, "
                                                "AVG(is_churn) AS base_rate, AVG(risk_score_full) / AVG(is_churn) AS raw_inflation_factor FROM cal"),
                                             ["mean_raw", "mean_calibrated", "base_rate", "raw_inflation_factor"]))
def calibration_centering(spark, sf):
    """Mean raw and calibrated score against the base rate."""
    c = Chain.shared(spark, sf).calibrated()
    return finalize(c.agg(F.avg("risk_score_full").alias("mean_raw"), F.avg("calibrated_probability").alias("mean_calibrated"),
                          F.avg("is_churn").alias("base_rate"))
                    .withColumn("raw_inflation_factor", F.col("mean_raw") / F.col("base_rate")))
