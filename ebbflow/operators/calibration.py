"""Probability calibration fitted on one half, reported on the other.

Both calibrators are fitted on score *blocks* (distinct score, n, positives):
the data is reduced by one aggregation and every fitting step touches only the
blocks.

* sigmoid (Platt): L2-regularised (C = 1, intercept free) 1-feature logistic
  regression solved by Newton's method; each iteration is one aggregation over
  the blocks (all score columns at once, grouped by column) and five sums per
  column come back to the driver;
* isotonic: adjacent violators pooled inside score ranges and across their
  borders (:mod:`ebbflow.operators.isotonic`); prediction clips outside the
  fitted range and interpolates linearly between fitted points.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow.functions.expr import hash_uniform
from ebbflow.operators import isotonic

FIT, EVAL = "calib_fit", "calib_eval"
BLOCKS_PER_TASK = 200_000


def with_calib_split(df: DataFrame, key: str = "msno", salt: str = "calib", frac: float = 0.5) -> DataFrame:
    """50/50 split from a hash uniform of the key: deterministic, independent of
    partitioning, class-balanced in expectation."""
    return df.withColumn("calib_split", F.when(hash_uniform(F.col(key), F.lit(salt)) < frac, FIT).otherwise(EVAL))


def blocks(df: DataFrame, score: str, label: str = "is_churn") -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label)).cast("double").alias("pos"))


class CalibrationError(ValueError):
    """A calibrator cannot be fitted to these rows."""


def _newton_step(g, w: float, b: float, C: float) -> tuple[float, float]:
    gw, gb = g["gw"] + w / C, g["gb"]
    hww, hwb, hbb = g["hww"] + 1.0 / C, g["hwb"], g["hbb"]
    det = hww * hbb - hwb * hwb
    if not abs(det) > 1e-300:
        raise CalibrationError("the sigmoid fit is singular: the scores or the labels do not vary")
    return (hbb * gw - hwb * gb) / det, (hww * gb - hwb * gw) / det


def fit_platt_many(fit_df: DataFrame, scores: list[str], label: str = "is_churn", C: float = 1.0,
                   max_iter: int = 50, tol: float = 1e-13) -> list[tuple[float, float]]:
    """(w, b) per score column minimising sum(log loss) + w^2 / (2C).  The score
    blocks of every column are one persisted frame tagged by column; each Newton
    iteration is ONE grouped aggregation for all columns (one row per column
    comes back), and a column stops moving once its own step is below ``tol``."""
    tagged = [blocks(fit_df, s, label).withColumn("m", F.lit(k)) for k, s in enumerate(scores)]
    b_df = tagged[0]
    for t in tagged[1:]:
        b_df = b_df.unionByName(t)
    held = b_df.persist(StorageLevel.MEMORY_AND_DISK)
    params = [(0.0, 0.0) for _ in scores]
    done, last = [False] * len(scores), [math.inf] * len(scores)
    try:
        # a step is one job over the blocks: tasks by their number, not by the shuffle setting
        b_df = held.coalesce(max(1, -(-held.count() // BLOCKS_PER_TASK)))
        for _ in range(max_iter):
            live = [k for k in range(len(scores)) if not done[k]]
            if not live:
                break
            w_col, b_col = F.lit(0.0), F.lit(0.0)
            for k in live:
                w_col = F.when(F.col("m") == k, F.lit(params[k][0])).otherwise(w_col)
                b_col = F.when(F.col("m") == k, F.lit(params[k][1])).otherwise(b_col)
            p = 1.0 / (1.0 + F.exp(-(w_col * F.col("x") + b_col)))
            r = F.col("n") * p - F.col("pos")
            h = F.col("n") * p * (1 - p)
            rows = (b_df.where(F.col("m").isin(*live)).groupBy("m")
                    .agg(F.sum(r * F.col("x")).alias("gw"), F.sum(r).alias("gb"),
                         F.sum(h * F.col("x") * F.col("x")).alias("hww"), F.sum(h * F.col("x")).alias("hwb"),
                         F.sum(h).alias("hbb")).collect())
            for g in rows:
                k = g["m"]
                w, b = params[k]
                dw, db = _newton_step(g, w, b, C)
                params[k] = (w - dw, b - db)
                last[k] = max(abs(dw), abs(db))
                done[k] = last[k] < tol
    finally:
        held.unpersist()
    if max(last) > 1e-6:  # tol asks for rounding level; this is what a fit must reach
        raise CalibrationError(f"the sigmoid fit did not settle in {max_iter} Newton steps")
    return params


def fit_platt(fit_df: DataFrame, score: str, label: str = "is_churn", C: float = 1.0,
              max_iter: int = 50, tol: float = 1e-13) -> tuple[float, float]:
    """Returns (w, b) minimising sum(log loss) + w^2 / (2C)."""
    return fit_platt_many(fit_df, [score], label, C, max_iter, tol)[0]


def apply_platt(score: str | Column, w: float, b: float) -> Column:
    x = F.col(score) if isinstance(score, str) else score
    return 1.0 / (1.0 + F.exp(-(F.lit(w) * x.cast("double") + F.lit(b))))


def fit_isotonic(fit_df: DataFrame, score: str, label: str = "is_churn", rows_per_range: int | None = None) -> isotonic.IsotonicFit:
    return isotonic.fit(blocks(fit_df.where(F.col(label).isNotNull()), score, label), rows_per_range)


def apply_isotonic(model: isotonic.IsotonicFit, df: DataFrame, score: str, out: str) -> DataFrame:
    """The fitted values, clipped outside the fitted range."""
    return isotonic.apply(model, df, score, out)


class Calibrator:
    """Fits both methods on the fit half of one score column and applies the winner."""

    def __init__(self, split_df: DataFrame, score: str, label: str = "is_churn",
                 platt: tuple[float, float] | None = None):
        fit = split_df.where(F.col("calib_split") == FIT)
        self.score = score
        self.w, self.b = platt if platt is not None else fit_platt(fit, score, label)
        self.iso = fit_isotonic(fit, score, label)

    @classmethod
    def for_scores(cls, split_df: DataFrame, scores: list[str], label: str = "is_churn") -> list["Calibrator"]:
        """One calibrator per score column; the sigmoid fits share their Newton passes."""
        fit = split_df.where(F.col("calib_split") == FIT)
        params = fit_platt_many(fit, scores, label)
        return [cls(split_df, s, label, platt=pr) for s, pr in zip(scores, params)]

    def add(self, df: DataFrame, method: str, out: str) -> DataFrame:
        if method == "sigmoid":
            return df.withColumn(out, apply_platt(self.score, self.w, self.b))
        if method == "isotonic":
            return apply_isotonic(self.iso, df, self.score, out)
        return df.withColumn(out, F.col(self.score).cast("double"))


def method_comparison(split_df: DataFrame, cal: Calibrator, model: str, label: str = "is_churn") -> DataFrame:
    """Brier of raw / sigmoid / isotonic on the eval half (one pass)."""
    ev = split_df.where(F.col("calib_split") == EVAL)
    ev = cal.add(cal.add(ev, "sigmoid", "_sig"), "isotonic", "_iso")
    y = F.col(label).cast("double")
    r = ev.agg(F.avg(F.pow(F.col(cal.score) - y, 2)).alias("raw"), F.avg(F.pow(F.col("_sig") - y, 2)).alias("sigmoid"),
               F.avg(F.pow(F.col("_iso") - y, 2)).alias("isotonic"), F.count(F.lit(1)).alias("n_eval"))
    long = r.unpivot(["n_eval"], ["raw", "sigmoid", "isotonic"], "method", "brier_score")
    return long.select(F.lit(model).alias("model"), "method", "brier_score", "n_eval")


def pick_winner(comparison: DataFrame) -> DataFrame:
    """Lowest eval Brier among the calibrated methods (raw excluded; ties -> sigmoid),
    with the improvement over raw.  Input has 3 rows per model."""
    w = Window.partitionBy("model").orderBy(F.col("brier_score"), F.when(F.col("method") == "sigmoid", 0).otherwise(1))
    cal = comparison.where(F.col("method") != "raw").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    raw = comparison.where(F.col("method") == "raw").select("model", F.col("brier_score").alias("raw_brier"))
    return cal.join(raw, "model").select(
        "model", F.col("method").alias("winner"), F.col("brier_score").alias("winner_brier"), "raw_brier",
        ((1 - F.col("brier_score") / F.col("raw_brier")) * 100.0).alias("pct_improvement"))


def quantile_bin(p: Column, edges: list[float]) -> Column:
    """E5: bin id = number of inner edges strictly below p (searchsorted left)."""
    total = F.lit(0)
    for e in edges:
        total = total + F.when(p > F.lit(e), 1).otherwise(0)
    return total


def reliability_table(df: DataFrame, score: str, label: str = "is_churn", n_bins: int = 10) -> DataFrame:
    """Mean predicted vs observed rate per quantile bin (linear quantile
    edges; empty bins dropped).  The nine inner edges are one small aggregate."""
    probs = [k / n_bins for k in range(1, n_bins)]
    edges = RA.quantile_row(df, {"e": (score, probs)})["e"]
    x = F.col(score).cast("double")
    return df.groupBy(quantile_bin(x, [float(e) for e in edges]).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"))




__all__ = ["with_calib_split", "fit_platt", "apply_platt", "fit_isotonic", "apply_isotonic", "Calibrator",
           "method_comparison", "pick_winner", "reliability_table", "quantile_bin", "math"]
