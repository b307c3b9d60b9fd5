"""Profiling of the feature table.

Wide statistics are computed as ONE aggregation (all columns, all pairs) and
turned long with ``unpivot``/``stack`` afterwards - never one job per column or
pair.  Quantiles are exact (linear interpolation), taken from ``functions.ranged``."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow.functions.expr import clip_keep_null, right_closed_bucket



BROADCAST_MAX_ROWS = 100_000


def join_per_group(big: DataFrame, per_group: DataFrame, on: list[str] | str) -> DataFrame:
    """Attach a per-group row (statistics of a low-cardinality group) to every
    row of ``big``.  The per-group side is persisted and counted first: up to
    ``BROADCAST_MAX_ROWS`` rows it is broadcast (a shuffle on a two- or
    three-valued key would put all rows into two or three tasks); beyond that
    the join is left to Spark's shuffle join, where AQE can split skewed keys."""
    per_group = per_group.persist(StorageLevel.MEMORY_AND_DISK)
    small = per_group.count() <= BROADCAST_MAX_ROWS
    return big.join(F.broadcast(per_group) if small else per_group, on)


def churn_rate_by(df: DataFrame, col: str, min_count: int = 0, label: str = "is_churn") -> DataFrame:
    """Churn % and count per category (NULL category dropped), groups below
    ``min_count`` removed, ranked by rate desc."""
    g = (df.where(F.col(col).isNotNull()).groupBy(col)
         .agg((F.avg(F.col(label).cast("double")) * 100.0).alias("churn_rate_pct"), F.count(F.lit(1)).alias("n"))
         .where(F.col("n") >= min_count))
    return g.select(F.lit(col).alias("feature"), F.col(col).cast("string").alias("category"), "churn_rate_pct", "n")


def rank_within(df: DataFrame, part: str, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)))


def class_distribution(df: DataFrame, label: str = "is_churn") -> DataFrame:
    """Counts and % per class."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))  # two rows


def churn_by_bucket(df: DataFrame, buckets: dict, label: str = "is_churn") -> DataFrame:
    """Churn % per right-closed bucket of each column, missing/outside as NULL bucket."""
    parts = []
    for name, (c, edges, labels) in buckets.items():
        parts.append(df.select(F.lit(name).alias("bucket_feature"),
                               right_closed_bucket(c, edges, labels).alias("bucket"), F.col(label)))
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy("bucket_feature", "bucket").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(label).cast("double")) * 100.0).alias("churn_rate_pct"))


def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column count and % missing, only columns with any, one aggregation."""
    n = F.count(F.lit(1)).alias("_n")
    wide = df.agg(n, *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "column", "n_missing")
    return long.where(F.col("n_missing") > 0).select(
        "column", "n_missing", (F.col("n_missing") * 100.0 / F.col("_n")).alias("pct_missing"))


def to_long(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(keep, cols, "column", "value")


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per numeric column missing %, min, median, mean, max, distinct count and
    the share of the most frequent value."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{k}") for k, c in enumerate(cols)])
    wide = sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"mean_{k}").alias("mean"))
                                                for k, c in enumerate(cols)])).alias("_s")).select("n", "_s.*")
    # one row per column and distinct value, counted in the tasks; everything else follows from it
    freq = to_long(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    per = freq.groupBy("column").agg(
        F.sum("k").alias("n_present"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n_distinct"), F.max("k").alias("top_count"))
    medians = RA.quantiles(df, [], {c: (c, 0.5) for c in cols}).unpivot([], cols, "column", "median")
    stats = wide.join(per, "column", "left").join(medians, "column", "left").withColumns(
        {"n_present": F.coalesce("n_present", F.lit(0)), "n_distinct": F.coalesce("n_distinct", F.lit(0))})
    return stats.select(
        "column", ((F.col("n") - F.col("n_present")) * 100.0 / F.col("n")).alias("pct_missing"), "min", "median",
        "mean", "max", "n_distinct", (F.col("top_count") * 100.0 / F.col("n_present")).alias("top_share_pct"))


def target_means(df: DataFrame, cols: list[str], label: str = "is_churn") -> DataFrame:
    """Mean of each feature per class, one row per feature."""
    wide = df.agg(*[F.struct(
        F.lit(c).alias("column"), F.avg(F.when(F.col(label) == 0, F.col(c).cast("double"))).alias("mean_not_churned"),
        F.avg(F.when(F.col(label) == 1, F.col(c).cast("double"))).alias("mean_churned")).alias(f"_{k}") for k, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[F.col(f"_{k}") for k in range(len(cols))])).alias("_s")).select("_s.*")


def _pair_corr(x: str, y: str) -> Column:
    """Pairwise-complete Pearson r from numerically stable pop. moments; a
    constant side gives NULL (not an ANSI divide error)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs = F.when(both, F.col(x).cast("double"))
    ys = F.when(both, F.col(y).cast("double"))
    den = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.try_divide(F.covar_pop(xs, ys), F.nullif(den, F.lit(0.0)))


def corr_with_target(df: DataFrame, cols: list[str], label: str = "is_churn", top: int = 15) -> DataFrame:
    """r(feature, label) for every feature in one aggregation, top by |r|."""
    wide = df.agg(*[_pair_corr(c, label).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "r")
    ranked = long.withColumn("rank", F.row_number().over(   # one row per feature: bounded
        Window.orderBy(F.abs(F.col("r")).desc_nulls_last(), F.col("feature"))))
    return ranked.where(F.col("rank") <= top)


MOMENTS_SCHEMA = "i int, j int, n double, sx double, sy double, sxy double, sxx double, syy double"


def _partition_moments(k: int):
    """Per-partition pairwise-complete moment sums of k centred columns, as
    matrix products over an Arrow batch (numpy inside the task)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        n = sx = sxy = sxx = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            m = (~np.isnan(x)).astype(float)
            xz = np.where(m > 0, x, 0.0)
            parts = (m.T @ m, xz.T @ m, xz.T @ xz, (xz * xz).T @ m)
            if n is None:
                n, sx, sxy, sxx = parts
            else:
                n, sx, sxy, sxx = n + parts[0], sx + parts[1], sxy + parts[2], sxx + parts[3]
        if n is None:
            return
        iu, ju = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "n": n[iu, ju], "sx": sx[iu, ju],
                            "sy": sx[ju, iu], "sxy": sxy[iu, ju], "sxx": sxx[iu, ju], "syy": sxx[ju, iu]})
    return run


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r of all column pairs (i < j), long form.

    Columns are centred by their global means (one small aggregate), then every
    task reduces its rows to k x k moment matrices with numpy (``mapInPandas``)
    and emits one row per pair; a ``groupBy(i, j)`` sums the partitions.  The
    shuffle is (#partitions x #pairs) rows whatever the table size - no
    per-pair job, no giant generated aggregate."""
    spark = df.sparkSession
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    centred = df.select(*[(F.col(c).cast("double") - F.lit(float(means[c] or 0.0))).alias(f"c{k}")
                          for k, c in enumerate(cols)])
    mom = (centred.mapInPandas(_partition_moments(len(cols)), MOMENTS_SCHEMA)
           .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxy", "sxx", "syy"]]))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = n * F.col("sxy") - sx * sy
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    # a side that is constant on the pair's complete rows has zero variance; the
    # centred sums leave rounding residue, so zero is judged relative to n * sxx
    flat = (vx <= F.lit(1e-10) * n * F.col("sxx")) | (vy <= F.lit(1e-10) * n * F.col("syy"))
    den = F.when(~flat, F.sqrt(vx * vy))
    names = small_frame(spark, [(k, c) for k, c in enumerate(cols)], "k int, name string")
    r = mom.select("i", "j", F.when(den > 0, cov / den).alias("r"))
    a = names.withColumnRenamed("k", "i").withColumnRenamed("name", "feature_a")
    b = names.withColumnRenamed("k", "j").withColumnRenamed("name", "feature_b")
    return r.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("feature_a", "feature_b", "r")


def collinear_pairs(df: DataFrame, cols: list[str], threshold: float = 0.85) -> DataFrame:
    return corr_matrix(df, cols).where(F.abs(F.col("r")) > threshold)


def grouped_quartiles(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Quartiles of a (clipped) value per group."""
    d = df.where(value.isNotNull())
    return RA.with_quantiles(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), d, by,
                             {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)})


def histogram_by_class(df: DataFrame, col: str, bins: int, clip: tuple | None = None,
                       label: str = "is_churn") -> DataFrame:
    """Equal-width histogram per class over that class's own [min, max],
    last bin closed, density = count / (n * width)."""
    x = clip_keep_null(col, *clip) if clip else F.col(col)
    d = df.select(F.col(label), x.cast("double").alias("x")).where(F.col("x").isNotNull())
    rng = d.groupBy(label).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    lo = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("hi") == F.col("lo"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    rng = rng.select(label, lo.alias("lo"), hi.alias("hi"), "n")
    j = join_per_group(d, rng, label)  # one row per class
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int"))
    g = j.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                                            F.first("hi").alias("hi"), F.first("n").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return g.select(F.lit(col).alias("feature"), label, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "count",
                    (F.col("count") / (F.col("n") * width)).alias("density"))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and whiskers (furthest data within 1.5 IQR) per group."""
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull())
    q = grouped_quartiles(d, x, by)
    iqr = F.col("q3") - F.col("q1")
    j = join_per_group(d, q, by)  # one row per group
    return j.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(x >= F.col("q1") - 1.5 * iqr, x)).alias("whisker_low"),
        F.max(F.when(x <= F.col("q3") + 1.5 * iqr, x)).alias("whisker_high"))


def category_share_and_rate(df: DataFrame, col: str, value, label: str = "is_churn") -> DataFrame:
    """One category's share of rows and its churn rate."""
    hit = F.col(col) == F.lit(value)
    return df.agg((F.avg(F.coalesce(hit, F.lit(False)).cast("double")) * 100.0).alias("share_pct"),
                  (F.avg(F.when(hit, F.col(label).cast("double"))) * 100.0).alias("churn_rate_pct"))
