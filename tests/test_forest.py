"""Forests grown in tasks: against a plain search for cuts, MLlib's forest, and variants scored one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.config import PROXY_EXCLUDE
from ebbflow.operators import forest as FO
from ebbflow.operators import ml as ML
from ebbflow.plans.pipeline import Chain

from conftest import SF_MID, SF_SMALL

SMALL = dict(trees=6, depth=5, min_leaf=3)


@pytest.fixture(scope="module")
def train(spark):
    return Chain(spark, SF_SMALL, "v1").scored().checkpoint(eager=True)


@pytest.fixture(scope="module")
def model(train):
    return ML.TrainedModel("random_forest", train, PROXY_EXCLUDE, **SMALL)


def same(a, b):
    return all(np.array_equal(getattr(x, c), getattr(y, c)) for x, y in zip(a, b, strict=True) for c in ("slot", "cut", "left", "value"))


def test_cuts_are_the_best_of_a_plain_search():
    """Two slots, both drawn at every node: a numeric one and a dummy."""
    rng = np.random.default_rng(3)
    cols = FO.Columns.of([("num__a", "a"), ("cat__c_x", "c")], [np.arange(5.0)])
    codes = np.stack([rng.integers(0, 6, 400), rng.integers(0, 2, 400)], axis=1).astype(np.uint8)
    label = (rng.random(400) < 0.2 + 0.1 * codes[:, 0] * codes[:, 1]).astype(np.uint8)
    times, weights, r = rng.poisson(1, 400).astype(np.uint8), (0.8, 1.3), FO.ForestRules(depth=3, min_leaf=10)
    tree = FO.grow_tree(codes, label, times, cols, r, weights, 0)

    def mass(own):
        return [(times[own] * (label[own] == c)).sum() * weights[c] for c in (0, 1)]

    def impurity(own):
        a, b = mass(own)
        return a * b / (a + b) if a + b else 0.0

    def plain(own, depth):
        """Nested cuts (slot, cut, left, right), or the share of positives; leaves of one class merged."""
        best = None
        for s, cuts in ((0, range(5)), (1, [0])):
            for c in cuts:
                left, right = own[codes[own, s] <= c], own[codes[own, s] > c]
                if min(times[left].sum(), times[right].sum()) < r.min_leaf:
                    continue
                gain = impurity(own) - impurity(left) - impurity(right)
                if gain > FO.MIN_GAIN and (best is None or gain > best[0] + 1e-12):
                    best = (gain, s, c, left, right)
        a, b = mass(own)
        if best is None or depth == r.depth:
            return b / (a + b)
        l, rt = (plain(x, depth + 1) for x in best[3:])
        if isinstance(l, float) and isinstance(rt, float) and (l > 0.5) == (rt > 0.5):
            return b / (a + b)
        return (best[1], best[2], l, rt)

    def unpacked(k):
        if tree.slot[k] < 0:
            return float(tree.value[k])
        return (int(tree.slot[k]), int(tree.cut[k]), unpacked(tree.left[k]), unpacked(tree.left[k] + 1))

    def close(x, y):
        return abs(x - y) < 1e-9 if isinstance(x, float) else x[:2] == y[:2] and close(x[2], y[2]) and close(x[3], y[3])
    want = plain(np.arange(400), 0)
    assert not isinstance(want, float) and close(unpacked(0), want)


def test_scores_are_near_mllibs_forest(spark, monkeypatch):
    """The same law by other draws: scores of both agree but for the noise of the draws."""
    train = Chain(spark, SF_MID, "v1").scored().checkpoint(eager=True)
    kw = dict(trees=60, depth=6, min_leaf=20)
    own = ML.TrainedModel("random_forest", train, **kw)
    monkeypatch.setattr(FO, "TABLE_BYTES", 0)  # a larger table
    theirs = ML.TrainedModel("random_forest", train, pre=own.pre, **kw)
    assert own.forest and theirs.forest is None and len(own.forest.trees) == 60
    both = theirs.score(own.score(train, "a"), "b").select("a", "b").toPandas()
    assert both["a"].corr(both["b"]) > 0.97
    assert abs(both["a"].mean() - both["b"].mean()) < 0.01
    assert abs(both["a"].std() / both["b"].std() - 1) < 0.1


def test_a_forest_does_not_depend_on_partitions_or_order(spark, train, model):
    again = ML.TrainedModel("random_forest", train.repartition(7).orderBy(F.md5("msno")), PROXY_EXCLUDE, pre=model.pre, **SMALL)
    assert same(again.forest.trees, model.forest.trees)
    twice = train.unionByName(train).unionByName(train.limit(9))
    a = ML.TrainedModel("random_forest", twice, pre=model.pre, **SMALL)
    b = ML.TrainedModel("random_forest", twice.repartition(5), pre=model.pre, **SMALL)
    assert same(a.forest.trees, b.forest.trees) and len({t.value.tobytes() for t in a.forest.trees}) == SMALL["trees"]


def test_rows_of_one_key_are_drawn_apart():
    mark = FO.own_marks(np.full(4000, 7, np.uint64), np.zeros((4000, 2), np.uint8), np.zeros(4000, np.uint8))
    times = FO.times_drawn(mark, 42, 0)
    assert np.unique(mark).size == 4000 and abs(times.mean() - 1) < 0.06 and abs(times.var() - 1) < 0.12


def test_swapped_scores_equal_the_scores_of_swapped_rows(spark, train, model):
    from ebbflow.operators.curves import ranking_metrics
    test = Chain(spark, SF_SMALL, "v2").scored().checkpoint(eager=True)
    feats = ["auto_renew_pct", "total_transactions", "city", "gender", "latest_is_auto_renew"]
    got = {r["feature"]: r for r in ML.permutation_importance(model, test, feats).collect()}
    pairs = ML.permutation_partner(test)
    variants = ML._scored_variants(model, test, pairs, feats, "", "msno")
    want = {r["_feature"]: r["pr_auc"] for r in ranking_metrics(variants, "score", "is_churn", None, ["_feature"]).collect()}
    for f in feats:
        assert got[f]["pr_auc_base"] == pytest.approx(want[""], abs=1e-12)
        assert got[f]["pr_auc_permuted"] == pytest.approx(want[f], abs=1e-12)
    assert len({round(x, 9) for x in want.values()}) > 2


def test_deep_trees_start_no_job_a_level(spark, train, model):
    """MLlib takes a job or more for each level; here the jobs do not grow with depth or trees."""
    tracker, n = spark.sparkContext.statusTracker(), []
    for k, kw in enumerate((dict(trees=2, depth=1), dict(trees=40, depth=16, min_leaf=1))):
        spark.sparkContext.setJobGroup(f"forest-{k}", "")
        try:
            ML.TrainedModel("random_forest", train, PROXY_EXCLUDE, pre=model.pre, **kw)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        n.append(len(tracker.getJobIdsForGroup(f"forest-{k}")))
    assert n[0] > 0 and n[1] <= n[0] + 2


def test_one_class_null_labels_and_no_rows(spark, train, model):
    one = ML.TrainedModel("random_forest", train.withColumn("is_churn", F.lit(0)), pre=model.pre, **SMALL)
    assert one.score(train).where("score <> 0").count() == 0
    half = train.withColumn("is_churn", F.when(F.col("gender") == "male", F.lit(None)).otherwise(F.col("is_churn")))
    assert ML.TrainedModel("random_forest", half, pre=model.pre, **SMALL).score(train).where("score is null").count() == 0
    none = ML.TrainedModel("random_forest", train.limit(0), pre=model.pre, **SMALL)
    assert none.score(train).count() == train.count()
