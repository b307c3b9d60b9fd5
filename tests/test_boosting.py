"""Boosted trees over shared passes against a plain grower that cuts one node at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.config import PROXY_EXCLUDE
from ebbflow.operators import boosting as B
from ebbflow.operators import ml as ML
from ebbflow.plans.pipeline import Chain

from conftest import SF_SMALL

RULES = [B.BoostRules(trees=3, lr=0.3, depth=5, leaves=31, min_rows=3, min_hess=0.0, l2=0.0),
         B.BoostRules(trees=3, lr=0.3, depth=6, leaves=5, min_rows=2, min_hess=0.5),
         B.BoostRules(trees=4, lr=0.2, depth=3, min_hess=1.0, exclude=tuple(PROXY_EXCLUDE))]


@pytest.fixture(scope="module")
def train(spark):
    return Chain(spark, SF_SMALL, "v1").scored().checkpoint(eager=True)


@pytest.fixture(scope="module")
def models(train):
    return B.fit_boosted(train, RULES)


def plain_cut(codes, g, h, rows, slots, r):
    def value(a, b):
        return (a / B.UNIT) ** 2 / max(b / B.UNIT + r.l2, 1e-12)
    G, H, best = sum(g[i] for i in rows), sum(h[i] for i in rows), None
    for s in slots:
        for b in range(int(max(codes[s])) + 1):
            left = [i for i in rows if codes[s][i] <= b]
            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
            if min(len(left), len(rows) - len(left)) < max(1, r.min_rows):
                continue
            if min(hl, H - hl) < r.min_hess * B.UNIT:
                continue
            gain = value(gl, hl) + value(G - gl, H - hl) - value(G, H)
            if gain > B.MIN_GAIN and (best is None or gain > best[0]):
                best = (gain, s, b)
    return best


def plain_fit(codes, label, slots, r, pos_weight):
    """Best first, one cut at a time; margins of all rows after the last tree."""
    n = len(label)
    margin = np.zeros(n)
    for _ in range(r.trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        w = np.where(label > 0, pos_weight, 1.0)
        g = [int(x) for x in np.rint(w * (p - label) * B.UNIT)]
        h = [int(x) for x in np.rint(w * p * (1 - p) * B.UNIT)]
        leaves = {1: list(range(n))}
        cuts = {1: plain_cut(codes, g, h, leaves[1], slots, r) if r.depth > 0 else None}
        while len(leaves) < (r.leaves or math.inf):
            open_ = [(-c[0], k) for k, c in cuts.items() if c]
            if not open_:
                break
            k = min(open_)[1]
            _, s, b = cuts.pop(k)
            rows = leaves.pop(k)
            for child, own in ((2 * k, [i for i in rows if codes[s][i] <= b]), (2 * k + 1, [i for i in rows if codes[s][i] > b])):
                leaves[child] = own
                cuts[child] = plain_cut(codes, g, h, own, slots, r) if child.bit_length() <= r.depth else None
        for rows in leaves.values():
            G, H = sum(g[i] for i in rows) / B.UNIT, sum(h[i] for i in rows) / B.UNIT + r.l2
            margin[rows] += -r.lr * G / H if H > 0 else 0.0
    return 1.0 / (1.0 + np.exp(-margin))


def test_equal_to_a_plain_grower(spark, train, models):
    pre = models[0].pre
    rows = pre.transform(train).select("msno", "is_churn", B.vector_to_array("features").alias("v")).orderBy("msno").collect()
    codes = B.to_codes(np.array([r["v"] for r in rows]), models[0].edges)
    label = np.array([float(r["is_churn"]) for r in rows])
    pos_weight = (len(label) - label.sum()) / label.sum()
    got = {r["msno"]: r["s"] for r in B.score_all(models, train, "s").select("msno", "s").collect()}
    names = [src for _, src in pre.encoded_names()]
    for k, r in enumerate(RULES):
        slots = [i for i, src in enumerate(names) if src not in r.exclude]
        want = plain_fit([list(map(int, c)) for c in codes], label, slots, r, pos_weight)
        assert np.allclose([got[x["msno"]][k] for x in rows], want, atol=1e-9), k
    assert max(len(t.values) for t in models[1].trees) == 5
    assert all(names[s] not in PROXY_EXCLUDE for t in models[2].trees for s, _ in t.routes.values())


def test_passes_are_shared_and_follow_the_depth(models):
    assert {m.passes for m in models} == {models[0].passes}
    assert models[0].passes <= 3 * 6  # the deepest trees: three of at most six levels


def test_trees_do_not_depend_on_partitions_or_company(spark, train, models):
    r = B.BoostRules(trees=18, lr=0.2, depth=3, subsample=0.7, colsample=0.5)
    alone = B.fit_boosted(train, [r], pre=models[0].pre)[0]
    spark.conf.set("ebbflow.ml.partitionBytes", "20000")  # several partitions: sums meet in a shuffle
    try:
        assert ML.training_partitions(spark, train.count(), len(alone.edges)) > 1
        company = B.fit_boosted(train.repartition(5), [B.BoostRules(trees=2, depth=2), r], pre=models[0].pre)[1]
    finally:
        spark.conf.unset("ebbflow.ml.partitionBytes")
    assert [t.routes for t in alone.trees] == [t.routes for t in company.trees]
    assert [t.values for t in alone.trees] == [t.values for t in company.trees]


def test_draws_are_shares(models):
    r = B.BoostRules(subsample=0.6, colsample=0.8)
    marks = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert abs(B.drawn_rows(r, marks, 3).mean() - 0.6) < 0.02
    assert (B.drawn_rows(r, marks, 3) != B.drawn_rows(r, marks, 4)).any()
    assert B.drawn_slots(r, np.arange(10), 1).size == 8


def test_one_class_and_null_labels(spark, train, models):
    r = [B.BoostRules(trees=2, depth=3)]
    one = B.fit_boosted(train.withColumn("is_churn", F.lit(0)), r, pre=models[0].pre)[0]
    assert one.score(train).where(F.col("score").isNull() | (F.col("score") >= 0.5)).count() == 0
    half = train.withColumn("is_churn", F.when(F.col("bd_missing") == 1, F.lit(None)).otherwise(F.col("is_churn")))
    kept = B.fit_boosted(train.where("bd_missing = 0 OR bd_missing IS NULL"), r, pre=models[0].pre)[0]
    assert B.fit_boosted(half, r, pre=models[0].pre)[0].train_rows == kept.train_rows


def test_random_search_equals_separate_fits(spark, train):
    from ebbflow.operators.curves import ranking_metrics
    dist = {"depth": [2, 3], "lr": [0.1, 0.3], "trees": [2, 4], "min_hess": [1.0]}
    sets = {"full": (), "proxy_controlled": tuple(PROXY_EXCLUDE)}
    found = B.random_search(train, sets, n_iter=3, param_dist=dist)
    assert [(c["feature_set"], c["draw"]) for c in found] == [(s, i) for s in sets for i in range(3)]
    split = ML.stratified_split(train, 0.8, salt="search").checkpoint(eager=True)
    for c in (found[1], found[3]):
        r = B.BoostRules(depth=c["depth"], lr=c["lr"], trees=c["trees"], min_hess=1.0, exclude=sets[c["feature_set"]])
        m = B.fit_boosted(split.where("split = 'train'"), [r])[0]
        assert ranking_metrics(m.score(split.where("split = 'test'")), "score").first()["roc_auc"] == c["roc_auc"]
    for s in sets:
        own = [c for c in found if c["feature_set"] == s]
        assert [c["best"] for c in own].index(True) == max(range(3), key=lambda i: (own[i]["roc_auc"], -i))
    tuned = B.tuned_models(train, found, sets)
    assert all(tuned[c["feature_set"]].rules.depth == c["depth"] for c in found if c["best"])
    assert tuned["full"].train_rows == train.count()


def test_draws_are_seeded_and_distinct():
    d = B.draws(15, B.PARAM_DIST, 42)
    assert d == B.draws(15, B.PARAM_DIST, 42) and len({tuple(x.items()) for x in d}) == 15
    assert len(B.draws(9, {"depth": [1, 2]}, 1)) == 2


def test_dummies_of_a_feature_are_counted_together(monkeypatch):
    rng = np.random.default_rng(7)
    pick, num = rng.integers(-1, 3, 500), rng.integers(0, 4, 500)
    codes = np.stack([num, pick == 0, pick == 1, pick == 2]).astype(np.uint8)
    names = [("num__a", "a"), ("cat__c_x", "c"), ("cat__c_y", "c"), ("cat__c_z", "c")]
    edges = [np.arange(3.0), *[np.zeros(1)] * 3]
    sets, starts = B.one_hot_sets(names, edges), np.array([0, 4, 6, 8, 10])
    assert sets == [[0], [1, 2, 3]]
    here, calls = rng.integers(0, 2, 500), []
    for scale in (1, 1 << 30):  # the second does not fit into one number with the rows
        g, h = np.rint(rng.normal(size=500) * 1e6), np.rint(rng.random(500) * 1e5) * scale
        got, count = np.zeros((2, 3, 10), np.int64), np.bincount
        monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
        B._add_sums(got, codes, here, g, h, sets, starts)
        monkeypatch.undo()
        for node in range(2):
            for s in range(4):
                for b in range(starts[s + 1] - starts[s]):
                    on = (here == node) & (codes[s] == b)
                    assert got[node, :, starts[s] + b].tolist() == [g[on].sum(), h[on].sum(), on.sum()]
    assert len(calls) == 2 * 2 + 2 * 3


def test_blocks_of_a_small_table_are_one_task_and_large_ones_use_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    assert B.block_partitions(spark, 90_000, 134) == 1
    assert B.block_partitions(spark, 900_000, 134) % cores == 0


def test_a_small_table_is_fitted_in_one_job(train, models, monkeypatch):
    """300 rounds of about seven passes are 2,000 jobs otherwise, whatever the rows."""
    def no_pass(*_):
        raise AssertionError("a pass for each level of each tree")

    monkeypatch.setattr(B, "_measure", no_pass)
    again = B.fit_boosted(train, RULES, pre=models[0].pre)
    assert [m.trees for m in again] == [m.trees for m in models]
    assert {m.passes for m in again} == {1}


def test_trees_grown_in_a_task_equal_shared_passes(spark, train, models):
    """Dummies, drawn rows and columns, a limit of leaves, one of depth only, no depth; and rows that come twice."""
    rules = [B.BoostRules(trees=5, lr=0.3, depth=6, leaves=9, min_rows=3, min_hess=1e-3, l2=0.0, subsample=0.7, colsample=0.6),
             B.BoostRules(trees=4, depth=3, min_hess=0.5, subsample=0.8), B.BoostRules(trees=2, depth=0), B.BoostRules(trees=0)]
    twice = train.unionByName(train.limit(60)).checkpoint(eager=True)
    here = B.fit_boosted(twice, rules, pre=models[0].pre)
    spark.conf.set("ebbflow.ml.partitionBytes", "20000")
    try:
        passed = B.fit_boosted(twice, rules, pre=models[0].pre)
    finally:
        spark.conf.unset("ebbflow.ml.partitionBytes")
    assert passed[0].passes > 1 == here[0].passes
    for a, b in zip(here, passed):
        assert [t.routes for t in a.trees] == [t.routes for t in b.trees]
        assert [t.values for t in a.trees] == [t.values for t in b.trees]
    assert len(here[0].trees[0].values) > 4 and here[3].trees == []
    none = B.fit_boosted(train.limit(0), rules[:1], pre=models[0].pre)[0]
    assert [t.routes for t in none.trees] == [{}] * 5 and all(set(t.values) == {1} for t in none.trees)


def test_residual_rule_is_mllibs_gradient_boosting(spark):
    """Scores of MLlib's GBTClassifier, the same where no slot has more values than bins (later trees differ in ties);
    also by shared passes."""
    from ebbflow import config as C
    from conftest import SF_MID
    full = Chain(spark, SF_MID, "v1").scored()
    train = full.select(*[(F.col(c).cast("long") % 17).alias(c) if c in C.NUMERIC_CONTINUOUS else c for c in full.columns]).checkpoint(eager=True)
    r = B.BoostRules(trees=2, depth=3, lr=0.1, l2=0.0, min_hess=0.0, residual=True)
    own = B.fit_boosted(train, [r], every_value=True)[0]
    theirs = ML.TrainedModel("boosted_trees", train, pre=own.pre, trees=2, depth=3, lr=0.1)
    both = theirs.score(own.score(train, "a"), "b").select("a", "b").toPandas()
    assert (both["a"] - both["b"]).abs().max() < 1e-6 and both["a"].nunique() > 20
    spark.conf.set("ebbflow.ml.partitionBytes", "200000")
    try:
        passed = B.fit_boosted(train, [r], pre=own.pre, every_value=True)[0]
    finally:
        spark.conf.unset("ebbflow.ml.partitionBytes")
    assert passed.passes > 1 == own.passes and passed.trees == own.trees


def test_every_value_of_few_is_an_edge(spark, train, models):
    """Rare values have edges; with more values than bins the edges are half way between neighbours."""
    from ebbflow.operators.forest import numeric_edges
    rows = [([float(i == 0), float(i)],) for i in range(320)]
    df = spark.createDataFrame(rows, "v array<double>").select(B.F.col("v"))
    from pyspark.ml.functions import array_to_vector
    a, b = numeric_edges(df.select(array_to_vector("v").alias("features")), 2)
    assert a.tolist() == [0.5] and b.size == 31 and b[0] == 9.5


def test_benchmark_boosting_takes_no_job_a_level(spark, train):
    """The benchmark's boosted trees are no MLlib fit, which takes a job or more for each level of 200 trees."""
    from ebbflow.plans import q_ml
    assert "boosted_trees" not in {kind for _, kind, _ in q_ml.BENCH_MODELS}
    tracker = spark.sparkContext.statusTracker()
    n = []
    for k, trees in enumerate((1, 30)):
        spark.sparkContext.setJobGroup(f"boost-{k}", "")
        try:
            B.fit_boosted(train, [B.BoostRules(trees=trees, depth=6, residual=True)], every_value=True)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        n.append(len(tracker.getJobIdsForGroup(f"boost-{k}")))
    assert n[0] > 0 and n[1] <= n[0] + 2
