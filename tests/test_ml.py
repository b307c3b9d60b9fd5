"""MLlib pieces on the small tables: unseen categories, pairing."""

from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.operators import ml as ML
from ebbflow.plans.pipeline import Chain

from conftest import SF_SMALL


def test_unseen_category_encodes_as_zeros(spark):
    train = Chain(spark, SF_SMALL, "v1").scored()
    pre = ML.Preprocessor().fit(train)
    test = Chain(spark, SF_SMALL, "v2").scored().limit(3).withColumn("city", F.lit(999))
    v = pre.transform(test).select("city_oh").collect()
    assert all(r["city_oh"].numNonzeros() == 0 for r in v)


def test_permutation_partner_is_a_bijection(spark):
    df = spark.range(3000).select(F.concat(F.lit("C+"), F.col("id").cast("string")).alias("msno"))
    pairs = ML.permutation_partner(df, bucket_rows=500)
    assert pairs.count() == 3000
    assert pairs.select("partner").distinct().count() == 3000
    assert pairs.where(F.col("msno") == F.col("partner")).count() < 30


def test_rule_baseline_scores_are_group_rates(spark):
    train = Chain(spark, SF_SMALL, "v1").scored()
    test = Chain(spark, SF_SMALL, "v2").scored()
    s = ML.rule_baseline(train, test).select("score").distinct().collect()
    assert 1 <= len(s) <= 2


def test_logistic_model_scores_in_unit_interval(spark):
    tm = ML.TrainedModel("logistic_regression", Chain(spark, SF_SMALL, "v1").scored(), C.PROXY_EXCLUDE, max_iter=50)
    r = tm.score(Chain(spark, SF_SMALL, "v2").scored()).agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_training_partitions_follow_data_size(spark):
    assert ML.training_partitions(spark, 15_000, 60) == 1
    # 10M rows x 63 doubles ~ 5 GB -> ~75 partitions of 64 MiB
    assert ML.training_partitions(spark, 10_000_000, 60) == -(-10_000_000 * 63 * 8 // (64 << 20))
    df = spark.range(100).repartition(7)
    assert ML.sized(df, 2).rdd.getNumPartitions() == 2
    assert ML.sized(df, 9).rdd.getNumPartitions() == 9
    assert ML.sized(df, 2).count() == 100


def test_one_pass_permutation_importance_equals_per_feature_passes(spark):
    """Brute force: swap one feature with the paired rows, score, PR-AUC; once per feature."""
    from ebbflow.operators.curves import ranking_metrics
    train = Chain(spark, SF_SMALL, "v1").scored()
    test = Chain(spark, SF_SMALL, "v2").scored()
    tm = ML.TrainedModel("logistic_regression", train, C.PROXY_EXCLUDE)
    feats = ["auto_renew_pct", "total_transactions", "city"]
    got = {r["feature"]: r for r in ML.permutation_importance(tm, test, feats).collect()}
    pairs = ML.permutation_partner(test)
    donor = test.select(F.col("msno").alias("partner"), *[F.col(f).alias(f"_p_{f}") for f in feats])
    wide = test.join(pairs, "msno").join(donor, "partner")
    base = ranking_metrics(tm.score(test), "score").first()["pr_auc"]
    for f in feats:
        swapped = wide.select(*[F.col(f"_p_{c}").alias(c) if c == f else F.col(c) for c in test.columns])
        ap = ranking_metrics(tm.score(swapped), "score").first()["pr_auc"]
        assert abs(got[f]["pr_auc_base"] - base) < 1e-12
        assert abs(got[f]["pr_auc_permuted"] - ap) < 1e-12


def test_tree_fits_and_scoring_use_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    for kind in ML.TREE_KINDS:
        assert ML.training_partitions(spark, 1_500, 134, kind) == 1
        assert ML.training_partitions(spark, 90_000, 134, kind) >= cores
        assert ML.training_partitions(spark, 900_000, 134, kind) % cores == 0
    assert ML.scoring_partitions(spark, 90_000, 30) >= cores
    assert ML.scoring_partitions(spark, 100) == 1


def test_driver_importance_equals_numpy_without_unpacked_slots(spark, monkeypatch):
    import numpy as np
    tm = ML.TrainedModel("logistic_regression", Chain(spark, SF_SMALL, "v1").scored(), C.PROXY_EXCLUDE, max_iter=50)
    test = Chain(spark, SF_SMALL, "v2").scored()
    v = np.array([r["features"].toArray() for r in tm.pre.transform(test).select("features").collect()])
    want: dict[str, float] = {}
    for (_, source), x in zip(tm.pre.encoded_names(), np.abs(tm.model.coefficients.toArray() * (v - v.mean(axis=0))).mean(axis=0)):
        want[source] = want.get(source, 0.0) + x

    def no_arrays(*_):
        raise AssertionError("an aggregate for each slot of an unpacked vector")

    monkeypatch.setattr(ML, "vector_to_array", no_arrays)
    got = {r["feature"]: r["mean_abs_contribution"] for r in ML.linear_driver_importance(tm, test).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)
    none = ML.linear_driver_importance(tm, test.limit(0)).collect()
    assert len(none) == len(want) and all(r["mean_abs_contribution"] == 0.0 for r in none)
