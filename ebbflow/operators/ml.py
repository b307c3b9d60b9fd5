"""Distributed model training, scoring and evaluation with pyspark.ml
(H1-H11, H26, H29-H31, B26, B34).

Preprocessing is fitted on the training frame only (H3/H4): exact medians for
imputation and population mean / std for scaling come from ONE aggregation each
(two fixed-size rows to the driver) and are applied as Catalyst expressions;
categoricals go through ``StringIndexer(handleInvalid="keep")`` +
``OneHotEncoder(dropLast=True)``: the indexer's extra "unseen" index is the encoder's last slot, which is dropped, so an
unseen test category encodes as all zeros.  Models are MLlib estimators, but for forests over a table that fits into
a task (:mod:`ebbflow.operators.forest`); MLlib's scores
are ``vector_to_array(probability)[1]``; all metrics are the exact distributed
ones from :mod:`ebbflow.operators.curves`."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

import math
import time

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow import config as C
from ebbflow.functions.expr import as_category, hash_uniform
from ebbflow.operators import forest as FO


def class_counts(df: DataFrame, label: str = "is_churn") -> tuple[int, int]:
    """(rows, positives): two scalars from one aggregation."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos")).first()
    return int(r["n"]), int(r["pos"] or 0)


def balanced_weights(counts: tuple[int, int]) -> tuple[float, float]:
    """N / (2 n_class) of the negatives and the positives."""
    n, pos = map(float, counts)
    neg = n - pos
    return (n / (2.0 * neg) if neg else 0.0), (n / (2.0 * pos) if pos else 0.0)


def with_balanced_weights(df: DataFrame, label: str = "is_churn", out: str = "class_weight",
                          counts: tuple[int, int] | None = None) -> DataFrame:
    """Balanced class weight n / (2 n_class); the two class counts are
    scalars brought to the driver."""
    w_neg, w_pos = balanced_weights(counts or class_counts(df, label))
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)))


def with_pos_weight(df: DataFrame, label: str = "is_churn", out: str = "class_weight",
                    counts: tuple[int, int] | None = None) -> DataFrame:
    """Boosted-tree analogue of ``scale_pos_weight``: positives weighted neg/pos."""
    n, pos = counts or class_counts(df, label)
    pos = float(pos)
    ratio = (float(n) - pos) / pos if pos else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def train_quotas(counts: dict, frac: float) -> dict:
    """Training rows of each class: ``floor(frac * n)`` in all, dealt by largest remainder (ties to
    the smaller label), so the sizes are exact."""
    take = math.floor(frac * sum(counts.values()))
    raw = {c: frac * k for c, k in counts.items()}
    out = {c: math.floor(v) for c, v in raw.items()}
    for c in sorted(raw, key=lambda c: (out[c] - raw[c], str(c)))[:take - sum(out.values())]:
        out[c] += 1
    return out


def stratified_split(df: DataFrame, frac: float = 0.8, salt: str = "split", key: str = "msno",
                     label: str = "is_churn") -> DataFrame:
    """H1: class-stratified split with exact class sizes.  In each class the rows with the smallest
    hash uniforms (ties by key) train; the place of the cut comes from ranged running sums over the
    distinct uniforms, so a class is never sorted in one task.  Two values a class reach the driver."""
    u = hash_uniform(F.col(key), F.lit(salt))
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    quota = train_quotas(counts, frac)
    blocks = df.groupBy(F.col(label).alias("_c"), u.alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    cum = RA.running_sums(blocks, ["_c"], [F.col("_u")], ["_n"])
    need = small_frame(df.sparkSession, [(c, k) for c, k in quota.items()], f"_q {dict(df.dtypes)[label]}, take bigint")
    cut = cum.join(F.broadcast(need), F.col("_c").eqNullSafe(F.col("_q"))).where(
        (F.col("cum__n") - F.col("_n") < F.col("take")) & (F.col("take") <= F.col("cum__n")))
    goes = F.lit(False)
    for c, at, left in cut.select("_c", "_u", F.col("take") - F.col("cum__n") + F.col("_n")).collect():
        own = F.col(label).eqNullSafe(F.lit(c))
        # the rows at the cut itself (of one uniform: as a rule one row)
        last = df.where(own & (u == at)).select(key).orderBy(key).limit(left).agg(F.max(key)).first()[0]
        goes = goes | (own & ((u < at) | ((u == at) & (F.col(key) <= F.lit(last)))))
    return df.withColumn("split", F.when(goes, "train").otherwise("test"))


def feature_columns(exclude=()) -> tuple[list[str], list[str]]:
    num = [c for c in C.BINARY_FLAGS + C.NUMERIC_CONTINUOUS if c not in exclude]
    cat = [c for c in C.CAT_ONEHOT if c not in exclude]
    return num, cat


class Preprocessor:
    """H3 + H4 fitted on a training frame."""

    def __init__(self, exclude=()):
        self.num, self.cat = feature_columns(exclude)

    def fit(self, train: DataFrame) -> "Preprocessor":
        med_row = RA.quantile_row(train, {c: (c, 0.5) for c in self.num})
        self.medians = {c: (float(med_row[c]) if med_row is not None and med_row[c] is not None else 0.0) for c in self.num}
        imputed = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.num]
        mom = train.agg(*[F.avg(x).alias(f"m_{c}") for x, c in zip(imputed, self.num)],
                        *[F.stddev_pop(x).alias(f"s_{c}") for x, c in zip(imputed, self.num)]).first()
        self.means = {c: float(mom[f"m_{c}"]) for c in self.num}
        self.stds = {c: (float(mom[f"s_{c}"]) if mom[f"s_{c}"] else 1.0) for c in self.num}
        cat_df = self._cat_strings(train)
        self.indexer = StringIndexer(inputCols=[f"{c}_s" for c in self.cat], outputCols=[f"{c}_i" for c in self.cat],
                                     handleInvalid="keep", stringOrderType="frequencyDesc").fit(cat_df)
        self.encoder = OneHotEncoder(inputCols=[f"{c}_i" for c in self.cat], outputCols=[f"{c}_oh" for c in self.cat],
                                     dropLast=True, handleInvalid="error").fit(self.indexer.transform(cat_df))
        return self

    def _cat_strings(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[as_category(c, numeric=(c != "gender")).alias(f"{c}_s") for c in self.cat])

    def statistics(self, spark) -> DataFrame:
        rows = [(c, self.medians[c], self.means[c], self.stds[c]) for c in self.num]
        return small_frame(spark, rows, "column string, median double, mean double, std double")

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = [((F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - F.lit(self.means[c]))
                   / F.lit(self.stds[c])).alias(f"{c}_z") for c in self.num]
        d = self._cat_strings(df.select("*", *scaled))
        d = self.encoder.transform(self.indexer.transform(d))
        asm = VectorAssembler(inputCols=[f"{c}_z" for c in self.num] + [f"{c}_oh" for c in self.cat],
                              outputCol="features")
        return asm.transform(d)

    def encoded_names(self) -> list[tuple[str, str]]:
        """(encoded name, source feature) of every vector slot (B34 input)."""
        out = [(f"num__{c}", c) for c in self.num]
        for c, labels in zip(self.cat, self.indexer.labelsArray):
            out += [(f"cat__{c}_{lab}", c) for lab in labels]  # 'unseen' slot dropped by dropLast
        return out


def make_classifier(kind: str, **kw):
    if kind == "logistic_regression":
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="class_weight",
                                  regParam=kw["reg"], elasticNetParam=0.0, standardization=False,
                                  maxIter=kw.get("max_iter", 1000), tol=1e-6)
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="class_weight",
                                      numTrees=kw.get("trees", 200), maxDepth=kw.get("depth", 16),
                                      minInstancesPerNode=kw.get("min_leaf", 20), featureSubsetStrategy="sqrt",
                                      seed=C.SEED)
    if kind == "boosted_trees":
        return GBTClassifier(featuresCol="features", labelCol="label", weightCol="class_weight",
                             maxIter=kw.get("trees", 200), maxDepth=kw.get("depth", 6), stepSize=kw.get("lr", 0.1),
                             subsamplingRate=kw.get("subsample", 1.0),
                             featureSubsetStrategy=kw.get("colsample", "all"),
                             minInstancesPerNode=kw.get("min_leaf", 1), seed=C.SEED)
    raise ValueError(kind)


# Bytes of one assembled training row per feature slot (dense doubles) and the
# target bytes per partition of the cached training frame.
SLOT_BYTES = 8
PARTITION_BYTES = 64 << 20
# Rows of a task in the fit of many trees: a row costs a walk and a histogram update in every tree and level.
TREE_ROWS = 4_096
SCORED_ROWS = 200_000
TREE_KINDS = ("random_forest", "boosted_trees")


def training_partitions(spark, n_rows: int, n_slots: int, kind: str | None = None) -> int:
    """Partitions for an iterative fit: each L-BFGS / tree-level step is one job
    over every partition, so the count follows the data size (``PARTITION_BYTES``
    per partition, ``ebbflow.ml.partitionBytes`` overrides) instead of the
    shuffle setting - a small frame is not split into tasks that cost more to
    schedule than to run, a large one still spreads over the cluster.  For tree
    ensembles bytes say little about the work: from ``TREE_ROWS`` rows a task on
    every core has its part, and larger frames come in equal waves."""
    target = int(spark.conf.get("ebbflow.ml.partitionBytes", str(PARTITION_BYTES)))
    est = n_rows * (n_slots + 3) * SLOT_BYTES  # as if dense: an upper bound for sparse vectors
    parts = max(1, math.ceil(est / max(1, target)))
    if kind in TREE_KINDS:
        cores = max(1, spark.sparkContext.defaultParallelism)
        parts = max(parts, min(cores, n_rows // TREE_ROWS))
        parts = parts if parts < cores else math.ceil(parts / cores) * cores
    return parts


def scoring_partitions(spark, n_rows: int, copies: int = 1) -> int:
    """Partitions to score ``copies`` variants of each row: every core from ``TREE_ROWS`` scored rows a task on,
    and no task beyond ``SCORED_ROWS``."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    scored = n_rows * copies
    return max(1, min(cores, scored // TREE_ROWS), math.ceil(scored / SCORED_ROWS))


def sized(df: DataFrame, parts: int) -> DataFrame:
    """``df`` dealt evenly over ``parts`` partitions.  Never a narrow ``coalesce``: it would pull the
    feature transform above it into the same few tasks."""
    return df.repartition(parts)


def prepare_labels(df: DataFrame, kind: str, label: str = "is_churn",
                   counts: tuple[int, int] | None = None) -> DataFrame:
    d = df.withColumn("label", F.col(label).cast("double"))
    return (with_pos_weight(d, label, counts=counts) if kind == "boosted_trees"
            else with_balanced_weights(d, label, counts=counts))


class TrainedModel:
    def __init__(self, kind: str, train: DataFrame, exclude=(), label: str = "is_churn", pre: Preprocessor | None = None,
                 key: str = "msno", **kw):
        t0 = time.time()
        self.kind, self.exclude = kind, tuple(exclude)
        self.pre = pre or Preprocessor(exclude).fit(train)  # fitted once where many models share a frame
        counts = class_counts(train, label)  # one pass: rows for the sizing, classes for the weights
        n = counts[0]
        self.train_rows, names = n, self.pre.encoded_names()
        slots, self.forest = len(names), None
        if kind == "random_forest" and FO.fits(n, names):
            rules = FO.ForestRules(kw.get("trees", 200), kw.get("depth", 16), kw.get("min_leaf", 20))
            rows = self.pre.transform(train.withColumn("label", F.col(label).cast("double"))).select(
                "features", "label", F.xxhash64(key).alias("mark"))
            self.forest = FO.Forest(rows, names, balanced_weights(counts), n, rules)
            self.fit_seconds = time.time() - t0
            return
        tr = self.pre.transform(prepare_labels(train, kind, label, counts)).select("features", "label", "class_weight")
        # the estimator iterates over this frame: sized to the data and kept
        # (memory, spilling to disk) for the fit; lost blocks recompute from
        # the checkpointed input
        tr = sized(tr, training_partitions(train.sparkSession, n, slots, kind)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.model = make_classifier(kind, reg=1.0 / n, **kw).fit(tr)
        finally:
            tr.unpersist()
        self.fit_seconds = time.time() - t0

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        if self.forest:
            return self.forest.with_scores(self.pre.transform(df), out).select(*df.columns, out)
        p = self.model.transform(self.pre.transform(df))
        keep = [c for c in df.columns]
        return p.select(*keep, vector_to_array("probability")[1].alias(out))


def rule_baseline(train: DataFrame, test: DataFrame, label: str = "is_churn") -> DataFrame:
    """flag = auto-renew off (missing -> training median); score = the flag
    group's training churn rate.  Two aggregates, applied as literals."""
    med = RA.quantile_row(train, {"m": ("latest_is_auto_renew", 0.5)})["m"]
    med = 1.0 if med is None else float(med)
    flag = F.coalesce(F.col("latest_is_auto_renew").cast("double"), F.lit(med)) == 0
    r = train.agg(F.avg(F.when(flag, F.col(label).cast("double"))).alias("off"),
                  F.avg(F.when(~flag, F.col(label).cast("double"))).alias("on")).first()
    return test.withColumn("score", F.when(flag, F.lit(r["off"])).otherwise(F.lit(r["on"])))


def linear_driver_importance(tm: TrainedModel, test: DataFrame) -> DataFrame:
    """H26(a): global mean |coef * (x_scaled - mean)| per encoded slot, dummies
    summed back to their source feature; exact for the logistic model.  Two
    passes of vector summaries over the test rows: the slot means, then the
    L1 norm of the centred slots (|coef| is a factor of every term)."""
    coef = list(tm.model.coefficients.toArray())
    names = tm.pre.encoded_names()
    d = tm.pre.transform(test).select("features")
    mean_abs = [0.0] * len(coef)
    if not d.isEmpty():
        centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(d).transform(d)
        s = centred.select(Summarizer.metrics("normL1", "count").summary(F.col("centred")).alias("s")).first()["s"]
        mean_abs = [abs(c) * float(x) / s["count"] for c, x in zip(coef, s["normL1"])]
    spark = test.sparkSession
    rows = [(enc, src, x) for (enc, src), x in zip(names, mean_abs)]
    enc = small_frame(spark, rows, "encoded string, feature string, contribution double")
    return (enc.groupBy("feature").agg(F.sum("contribution").alias("mean_abs_contribution"))
            .withColumn("method", F.lit("linear contribution |coef * (x - mean)|")))


def encoded_to_source(tm: TrainedModel) -> DataFrame:
    """Encoded slot names -> source feature, by prefix strip and the
    categorical base name."""
    spark = tm.pre.indexer.sparkSession if hasattr(tm.pre.indexer, "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    names = small_frame(spark, [(e,) for e, _ in tm.pre.encoded_names()], "encoded string")
    cats = "|".join(tm.pre.cat)
    return names.select("encoded", F.when(F.col("encoded").startswith("num__"), F.regexp_extract("encoded", r"^num__(.*)$", 1))
                        .otherwise(F.regexp_extract("encoded", rf"^cat__({cats})_.*$", 1)).alias("feature"))


def driver_direction(tm: TrainedModel, test: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    """Decile bins of one numeric feature x mean linear contribution and mean score."""
    idx = [e for e, _ in tm.pre.encoded_names()].index(f"num__{feature}")
    coef = float(tm.model.coefficients.toArray()[idx])
    scored = tm.score(test)
    edges = RA.quantile_row(scored, {"e": (feature, [k / bins for k in range(1, bins)])})["e"]
    x = F.col(feature).cast("double")
    b = sum((F.when(x > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    z = (F.coalesce(x, F.lit(tm.pre.medians[feature])) - F.lit(tm.pre.means[feature])) / F.lit(tm.pre.stds[feature])
    return scored.where(x.isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.avg(F.lit(coef) * z).alias("mean_contribution"), F.avg("score").alias("mean_score"))



def permutation_partner(df: DataFrame, key: str = "msno", bucket_rows: int = 10_000, salt: str = "perm") -> DataFrame:
    """Deterministic derangement-like pairing for permutation importance: rows
    are hashed into buckets of ~``bucket_rows`` rows, ranked inside the bucket by
    two independent hash orders, and rank r of order 1 is paired with rank r of
    order 2.  Windows are partitioned by bucket, so no task holds more than a
    bucket; the number of buckets grows with the table."""
    n = df.count()
    buckets = max(1, n // bucket_rows)
    b = (F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit(salt + "b"))), 1, 8), 16, 10).cast("bigint") % buckets)
    h1 = hash_uniform(F.col(key), F.lit(salt + "1"))
    h2 = hash_uniform(F.col(key), F.lit(salt + "2"))
    from pyspark.sql import Window
    w1 = Window.partitionBy("_b").orderBy(h1, F.col(key))
    w2 = Window.partitionBy("_b").orderBy(h2, F.col(key))
    base = df.select(key, b.alias("_b"))
    left = base.withColumn("_r", F.row_number().over(w1))
    right = base.withColumn("_r", F.row_number().over(w2)).withColumnRenamed(key, "partner")
    return left.join(right, ["_b", "_r"]).select(key, "partner")


def _scored_variants(tm, test: DataFrame, pairs: DataFrame, features: list[str], base: str, key: str) -> DataFrame:
    """Every variant of the rows as rows of its own, scored by the model."""
    donor = test.select(F.col(key).alias("partner"), *[F.col(f).alias(f"_p_{f}") for f in features])
    wide = test.join(pairs, key).join(donor, "partner").drop("partner").checkpoint(eager=True)
    # a row is scored once for each variant: tasks by that work, not by the bytes of the join
    wide = sized(wide, scoring_partitions(test.sparkSession, wide.count(), len(features) + 1))
    long = wide.select("*", F.explode(F.array(F.lit(base), *[F.lit(f) for f in features])).alias("_feature"))
    swapped = long.select("_feature", *[F.when(F.col("_feature") == F.lit(c), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c)
                                        if c in features else F.col(c) for c in test.columns])
    return tm.score(swapped)


def permutation_importance(tm: TrainedModel, test: DataFrame, features: list[str], label: str = "is_churn",
                           key: str = "msno") -> DataFrame:
    """H26(b): PR-AUC drop when one source feature's values are swapped between
    paired rows (all other columns kept).  The partner's feature values are
    attached with ONE join and the result is checkpointed.  Every variant - the
    unpermuted rows plus one copy per feature with only that column swapped - is
    then scored in ONE pass over an exploded frame, and all PR-AUCs come from
    one grouped curve computation (group = permuted feature), so the model runs
    as one parallel job instead of one job per feature.  A forest of tasks takes the codes of a row and of its partner
    instead of exploded rows, and walks a variant only down the trees whose paths meet its feature."""
    from ebbflow.operators.curves import ranking_metrics
    spark = test.sparkSession
    pairs = permutation_partner(test, key)
    base = ""  # group of the unpermuted rows
    if getattr(tm, "forest", None):
        coded = tm.forest.with_codes(tm.pre.transform(test), "codes").select(key, F.col(label).alias("label"), "codes").checkpoint(eager=True)
        donor = coded.select(F.col(key).alias("partner"), F.col("codes").alias("donor"))
        wide = coded.join(pairs, key).join(donor, "partner").select("label", "codes", "donor").checkpoint(eager=True)
        wide = sized(wide, scoring_partitions(spark, wide.count(), len(features) + 1))
        scored = tm.forest.swapped_scores(wide, features).select(F.col("label").alias(label), F.posexplode("scores").alias("_k", "score")) \
            .select(F.array(F.lit(base), *map(F.lit, features))[F.col("_k")].alias("_feature"), label, "score")
    else:
        scored = _scored_variants(tm, test, pairs, features, base, key).select("_feature", label, "score")
    scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # one row per variant (features + 1) comes back
        aps = {r["_feature"]: r["pr_auc"] for r in
               ranking_metrics(scored, "score", label, None, ["_feature"]).select("_feature", "pr_auc").collect()}
    finally:
        scored.unpersist()
    base_ap = float(aps[base])
    rows = [(f, base_ap, float(aps[f]), float(base_ap - aps[f])) for f in features]
    return small_frame(spark, rows, "feature string, pr_auc_base double, pr_auc_permuted double, importance double") \
        .withColumn("method", F.lit("permutation (hash-paired rows), PR-AUC drop"))
