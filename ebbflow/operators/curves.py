"""Exact ranking metrics without a single-partition sort.

Step 1 collapses rows to score blocks ``(score, pos, neg)`` with a partial +
final aggregation (ties of a real model are rare, of a scorecard common).
Step 2 takes running sums and group totals in descending score order from
``functions.ranged`` (blocks range-partitioned on (group, score), computed once;
prefix offsets and totals from the per-range totals, never a window over a group).

All of it is exact: AP is sklearn's step sum over distinct thresholds, ROC-AUC
the trapezoid (= Mann-Whitney with tied pairs counted one half).
"""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.expr import hash_uniform
from ebbflow.functions.ranged import running_sums

def score_blocks(df: DataFrame, score: str, label: str = "is_churn", weight: str | Column | None = None,
                 by: list[str] | None = None) -> DataFrame:
    by = by or []
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    y = F.col(label).cast("double")
    return (df.select(*by, F.col(score).cast("double").alias("score"), (w * y).alias("_p"), (w * (1 - y)).alias("_n"))
            .groupBy(*by, "score").agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg")))


def curve(df: DataFrame, score: str, label: str = "is_churn", weight=None, by: list[str] | None = None,
          rows_per_range: int | None = None) -> DataFrame:
    """One row per distinct score with cumulative TP/FP, totals, and the
    ROC (fpr, tpr) and PR (precision, recall) coordinates at that threshold."""
    by = by or []
    blocks = score_blocks(df, score, label, weight, by)
    cum = running_sums(blocks, by, [F.col("score").desc()], ["pos", "neg"], rows_per_range)
    cum = cum.withColumnsRenamed({"all_pos": "P", "all_neg": "N"})
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return cum.select(
        *by, "score", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "P", "N",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(F.col("P") > 0, tp / F.col("P")).alias("recall"),
        F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr"))


def ranking_metrics(df: DataFrame, score: str, label: str = "is_churn", weight=None,
                    by: list[str] | None = None, rows_per_range: int | None = None) -> DataFrame:
    """H12 + H13: ROC-AUC and average precision per ``by`` group."""
    by = by or []
    c = curve(df, score, label, weight, by, rows_per_range)
    ap_term = F.col("pos") * F.col("precision")
    roc_term = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    agg = c.groupBy(*by).agg(F.sum(ap_term).alias("_ap"), F.sum(roc_term).alias("_roc"),
                             F.first("P").alias("P"), F.first("N").alias("N"))
    return agg.select(*by, F.when(F.col("P") > 0, F.col("_ap") / F.col("P")).alias("pr_auc"),
                      F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_roc") / (F.col("P") * F.col("N")))
                      .alias("roc_auc"))


def precision_recall_at_k(df: DataFrame, score: str, k: int, label: str = "is_churn") -> DataFrame:
    """Precision and recall among the k highest scores; the tie block that
    straddles position k contributes its positives in proportion."""
    blocks = score_blocks(df, score, label)
    cum = running_sums(blocks.withColumn("n", F.col("pos") + F.col("neg")), [], [F.col("score").desc()], ["pos", "n"])
    above_n = F.col("cum_n") - F.col("n")
    above_pos = F.col("cum_pos") - F.col("pos")
    cut = cum.where((above_n < F.lit(k)) & (F.col("cum_n") >= F.lit(k)))
    positives = above_pos + (F.lit(k) - above_n) * F.col("pos") / F.col("n")
    return cut.select(F.lit(k).cast("bigint").alias("k"), F.col("score").alias("cutoff_score"),
                      (positives / F.lit(k)).alias("precision_at_k"),
                      F.when(F.col("all_pos") > 0, positives / F.col("all_pos")).alias("recall_at_k"))


#: largest mean whose draws come from a table; attempts of the rejection draw above it
TABLE_MEAN, ATTEMPTS = 9, 16
DRAWS_PER_TASK = 30_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _poisson_cdf(mean: int) -> list[float]:
    """P(X <= 0), P(X <= 1), .. as far as a 32-bit uniform can tell them from one."""
    out, term, total = [], math.exp(-mean), 0.0
    while total < 1 - 2.0 ** -33 and len(out) < 80:
        total += term
        out.append(total)
        term *= mean / len(out)
    return out


def poisson_count_weight(n: Column, text: Column) -> Column:
    """A Poisson(n) draw for a whole number n >= 1: the sum of n Poisson(1) weights, at a cost that does
    not depend on n.  Up to ``TABLE_MEAN`` the inverse distribution function of a uniform of ``text``,
    above it transformed rejection (exact; the proposal is a ratio of uniforms, accepted nine times of ten)."""
    table = F.array(*[F.array(*[F.lit(c) for c in _poisson_cdf(m)]) for m in range(1, TABLE_MEAN + 1)])
    small = _let(hash_uniform(text, F.lit(":0")), lambda u: F.size(F.filter(F.element_at(table, n.cast("int")), lambda c: c <= u))).cast("double")
    mean = n.cast("double")
    b = 0.931 + 2.53 * F.sqrt(mean)
    a = -0.059 + 0.02483 * b

    factorials = F.array(*[F.log(F.lit(float(math.factorial(i)))) for i in range(10)])

    def attempt(j):
        part = lambda digest, at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
        uniforms = lambda digest: F.struct(((part(digest, 1) + 0.5) / 4294967296.0 - 0.5).alias("u"), ((part(digest, 9) + 1.0) / 4294967296.0).alias("v"))
        return _let(F.md5(F.concat(text, F.lit(":"), j.cast("string"))), lambda digest: _let(uniforms(digest), lambda r: _let(
            F.floor((2.0 * a / (0.5 - F.abs(r["u"])) + b) * r["u"] + mean + 0.43).cast("double"), lambda k: accepted(r["u"], r["v"], k))))

    def accepted(u, v, k):
        us, z = 0.5 - F.abs(u), k + 1.0         # ln k! by its series; the acceptance asks for k >= 0
        log_k = F.when(k < 10, F.element_at(factorials, F.least(F.greatest(k, F.lit(0.0)), F.lit(9.0)).cast("int") + 1)).otherwise(
            (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z))
        inner = (us >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2.0))
        outer = (k >= 0) & ((us >= 0.013) | (v <= us)) & (
            F.log(v) + F.log(1.1239 + 1.1328 / (b - 3.4)) - F.log(a / (us * us) + b) <= -mean + k * F.log(mean) - log_k)
        return F.when(inner | outer, k)

    large = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("double"), lambda got, j: F.coalesce(got, attempt(j)))
    return F.when(n <= TABLE_MEAN, small).otherwise(F.coalesce(large, mean))


def score_cells(df: DataFrame, scores: dict[str, str], label: str = "is_churn") -> DataFrame:
    """Rows collapsed to cells of equal label and equal scores of all models, with their count ``n``
    and a text that names the cell."""
    cols = [F.col(c).cast("double").alias(m) for m, c in scores.items()]
    cells = df.select(F.col(label).cast("int").alias("y"), *cols).groupBy("y", *scores).agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string("%d" + "|%.15f" * len(scores), F.col("y"), *[F.col(m) for m in scores])
    return cells.where(F.col("y").isNotNull()).withColumn("cell", text)


def bootstrap_pr_auc(df: DataFrame, scores: dict[str, str], reference: str, n_boot: int = 500, label: str = "is_churn",
                     salt: str = "boot", batch_rows: int = 20_000_000) -> DataFrame:
    """Paired Poisson bootstrap of PR-AUC(model) - PR-AUC(reference).

    ``scores`` maps model names to score columns of ``df`` (a row per customer).  Rows of equal
    label and equal scores under every model move together, so they are one cell with a count and
    a replicate gives the cell one Poisson(count) weight: the law is that of a Poisson(1) weight a
    row, the cost is that of the cells.  The weight is a function of the cell and the replicate
    alone and is shared by all models (paired).  Replicates run in batches of at most about
    ``batch_rows`` weighted cells; a grouped ranged curve gives all (replicate, model) values.
    Output: per non-reference model the observed difference and the 2.5 / 97.5 percentiles
    (linear interpolation) of the replicate differences."""
    spark = df.sparkSession
    cells = score_cells(df, scores, label).persist()
    try:
        n_cells = max(1, cells.count())
        step = max(1, min(n_boot, batch_rows // (n_cells * len(scores))))
        by_model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in scores])).alias("s")
        ap_rows = []
        for lo in range(1, n_boot + 1, step):
            reps = F.explode(F.sequence(F.lit(lo), F.lit(min(n_boot, lo + step - 1)))).alias("b")
            # a cell and replicate costs a few microseconds: partitions by that work, not by bytes
            parts = max(1, min(n_cells, n_cells * step // DRAWS_PER_TASK))
            drawn = cells.repartition(parts, "cell").select("*", reps).withColumn("_w", poisson_count_weight(F.col("n"), F.concat("cell", F.lit(salt), F.col("b").cast("string"))))
            long = drawn.select("b", "y", "_w", by_model).select("b", "y", "_w", "s.*")
            boot = ranking_metrics(long, "score", "y", "_w", ["b", "model"], DRAWS_PER_TASK)
            ap_rows += [(int(r["b"]), r["model"], r["pr_auc"]) for r in boot.select("b", "model", "pr_auc").collect()]
        observed = ranking_metrics(cells.select("y", "n", by_model).select("y", "n", "s.*"), "score", "y", F.col("n").cast("double"), ["model"])
        seen = {r["model"]: r["pr_auc"] for r in observed.collect()}        # a row a model
    finally:
        cells.unpersist()
    by_rep: dict[int, dict[str, float]] = {}
    for b, m, ap in ap_rows:                # replicates x models values
        by_rep.setdefault(b, {})[m] = ap
    rows = []
    for m in scores:
        diffs = sorted(r[m] - r[reference] for r in by_rep.values() if r.get(m) is not None and r.get(reference) is not None)
        if m != reference and diffs and seen.get(m) is not None and seen.get(reference) is not None:
            rows.append((m, seen[m] - seen[reference], _percentile(diffs, 0.025), _percentile(diffs, 0.975), len(diffs)))
    return small_frame(spark, rows, "model string, observed_diff double, ci95_low double, ci95_high double, n_boot bigint")


def _percentile(ordered: list[float], p: float) -> float:
    """Linear interpolation between sorted values."""
    place = p * (len(ordered) - 1)
    lo, hi = ordered[math.floor(place)], ordered[math.ceil(place)]
    return lo + (place - math.floor(place)) * (hi - lo)
