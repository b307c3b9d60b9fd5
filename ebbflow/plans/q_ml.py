"""Registered queries: splits, preprocessing statistics, MLlib models trained on
round v1 and evaluated on round v2, rule baseline, importance, benchmark
(B26, B34, F4, F6, H1-H8, H10, H11, H26, H29, H31)."""

from __future__ import annotations

from ebbflow.sources.literal import small_frame

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.operators import boosting as BO
from ebbflow.operators import calibration as CA
from ebbflow.operators import curves as CU
from ebbflow.operators import ml as ML
from ebbflow.operators import scoring as SC
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import hash_u, q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.registry import register
from ebbflow.sources.stages import input_identity

_MODELS: dict = {}


def _train(spark, sf) -> DataFrame:
    return Chain.shared(spark, sf, "v1").scored()


def _test(spark, sf) -> DataFrame:
    return Chain.shared(spark, sf, "v2").scored()


FEATURE_SETS = {"full": (), "proxy_controlled": tuple(C.PROXY_EXCLUDE)}

# The second boosted configuration.
BEST_FIRST = dict(trees=300, lr=0.05, depth=8, leaves=31, min_rows=100, min_hess=1e-3, subsample=0.8, colsample=0.8, l2=0.0)


def trained(spark, sf, kind, exclude=(), **kw):
    def key(ex):
        return (spark.sparkContext.applicationId, input_identity(spark, sf), kind, tuple(ex), tuple(sorted(kw.items())))
    if key(exclude) not in _MODELS:
        if kind == "best_first":  # both feature sets grow in the same passes
            rules = [BO.BoostRules(**kw, exclude=ex) for ex in FEATURE_SETS.values()]
            for ex, model in zip(FEATURE_SETS.values(), BO.fit_boosted(_train(spark, sf), rules)):
                _MODELS[key(ex)] = model
        elif kind == "residual_boosting":
            rules = [BO.BoostRules(**kw, exclude=tuple(exclude), l2=0.0, min_hess=0.0, residual=True)]
            _MODELS[key(exclude)], = BO.fit_boosted(_train(spark, sf), rules, every_value=True)
        else:
            _MODELS[key(exclude)] = ML.TrainedModel(kind, _train(spark, sf), exclude, **kw)
    return _MODELS[key(exclude)]


def _split_sql(frac=0.8):
    u = hash_u("msno || 'split'")
    return q(f"""
, cls AS (SELECT is_churn, COUNT(*) AS k FROM sc GROUP BY 1),
raw AS (SELECT is_churn, {frac}::DOUBLE * k AS r, floor({frac}::DOUBLE * k) AS f FROM cls),
rem AS (SELECT *, ROW_NUMBER() OVER (ORDER BY f - r, CAST(is_churn AS VARCHAR)) AS rr FROM raw),
quota AS (SELECT is_churn, f + CASE WHEN rr <= (SELECT floor({frac}::DOUBLE * SUM(k)) FROM cls) - (SELECT SUM(f) FROM raw) THEN 1 ELSE 0 END AS take FROM rem),
ranked AS (SELECT msno, is_churn, ROW_NUMBER() OVER (PARTITION BY is_churn ORDER BY {u}, msno) AS rk FROM sc)
SELECT r.msno, r.is_churn, CASE WHEN r.rk <= q.take THEN 'train' ELSE 'test' END AS split FROM ranked r JOIN quota q ON q.is_churn = r.is_churn""")


@register("stratified_split", _split_sql())
def stratified_split(spark, sf):
    """H1: 80/20 split, stratified by class with exact class sizes (stable under repartitioning)."""
    return ML.stratified_split(_test(spark, sf)).select("msno", "is_churn", "split")


SAMPLE_CAP = 300_000  # fixed value: the benchmark's capped training sample


def _strat_sql():
    u = hash_u("msno || 'strat'")
    return q(f"""
, cls AS (SELECT is_churn, COUNT(*) AS k FROM sc GROUP BY 1),
tot AS (SELECT SUM(k) AS n FROM cls),
raw AS (SELECT is_churn, k, {SAMPLE_CAP} * k * 1.0 / n AS r, floor({SAMPLE_CAP} * k * 1.0 / n) AS f FROM cls, tot),
rem AS (SELECT *, ROW_NUMBER() OVER (ORDER BY r - f DESC, CAST(is_churn AS VARCHAR)) AS rr FROM raw),
quota AS (SELECT is_churn, f + CASE WHEN rr <= {SAMPLE_CAP} - (SELECT SUM(f) FROM raw) THEN 1 ELSE 0 END AS take FROM rem),
ranked AS (SELECT msno, is_churn, ROW_NUMBER() OVER (PARTITION BY is_churn ORDER BY {u}, msno) AS rk FROM sc)
SELECT r.msno, r.is_churn FROM ranked r JOIN quota q ON q.is_churn = r.is_churn
WHERE (SELECT n FROM tot) <= {SAMPLE_CAP} OR r.rk <= q.take""", "v1")


@register("stratified_sample", _strat_sql())
def stratified_sample(spark, sf):
    """H1 (capped stratified sample of the v1 training rows, exact class sizes)."""
    from ebbflow.operators.sampling import stratified_sample as strat
    return strat(_train(spark, sf).select("msno", "is_churn"), SAMPLE_CAP)


def _tsplit_sql(r, name):
    return q(f"SELECT '{name}' AS split, CAST(COUNT(*) AS BIGINT) AS n_rows, AVG(is_churn) AS churn_rate, "
             f"AVG(has_transactions_data) AS txn_coverage FROM sc", r)


@register("temporal_split", sql_final(f"SELECT * FROM ({_tsplit_sql('v1', 'train')}) a UNION ALL SELECT * FROM ({_tsplit_sql('v2', 'test')}) b",
                                      ["churn_rate", "txn_coverage"]))
def temporal_split(spark, sf):
    """H2: train on the v1 cutoff, test on v2 (same feature code, another cutoff)."""
    def stats(df, name):
        return df.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_rows"),
                      F.avg("is_churn").alias("churn_rate"), F.avg("has_transactions_data").alias("txn_coverage"))
    return finalize(stats(_train(spark, sf), "train").unionByName(stats(_test(spark, sf), "test")))


def _stats_sql():
    num = C.BINARY_FLAGS + C.NUMERIC_CONTINUOUS
    parts = []
    for c in num:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column, m AS median, AVG(COALESCE({x}, m)) AS mean, "
                     f"COALESCE(NULLIF(stddev_pop(COALESCE({x}, m)), 0), 1.0) AS std "
                     f"FROM sc, (SELECT COALESCE(quantile_cont({x}, 0.5), 0.0) AS m FROM sc) med GROUP BY m")
    return sql_final(q(" UNION ALL ".join(parts), "v1"), ["median", "mean", "std"])


@register("preprocess", _stats_sql())
def preprocess(spark, sf):
    """H3: training medians (exact) and population mean / std after imputation."""
    pre = ML.Preprocessor().fit(_train(spark, sf))
    return finalize(pre.statistics(spark))


def _onehot_sql():
    parts = []
    for c in C.CAT_ONEHOT:
        cat = (f"CASE WHEN {c} IS NULL THEN 'nan' ELSE printf('%.1f', CAST({c} AS DOUBLE)) END" if c != "gender"
               else f"COALESCE({c}, 'nan')")
        parts.append(f"SELECT '{c}' AS column, {cat} AS category, COUNT(*) AS n_train FROM sc GROUP BY 2")
    return q("SELECT \"column\", category, CAST(n_train AS BIGINT) AS n_train, "
             "CAST(ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n_train DESC, category) - 1 AS INTEGER) AS category_index FROM ("
             + " UNION ALL ".join(parts) + ")", "v1")


@register("onehot_stats", _onehot_sql())
def onehot_stats(spark, sf):
    """H4: training vocabulary per categorical (missing = own category), with the
    encoder's index (frequency desc, ties alphabetical); unseen test values -> all-zero."""
    train = _train(spark, sf)
    pre = ML.Preprocessor().fit(train)
    idx = small_frame(spark, [(c, lab, i) for c, labels in zip(pre.cat, pre.indexer.labelsArray)
                                 for i, lab in enumerate(labels)], "column string, category string, category_index int")
    from ebbflow.functions.expr import as_category
    counts = reduce(DataFrame.unionByName, [
        train.groupBy(as_category(c, numeric=(c != "gender")).alias("category")).agg(F.count(F.lit(1)).alias("n_train"))
        .withColumn("column", F.lit(c)) for c in C.CAT_ONEHOT])
    return counts.join(idx, ["column", "category"], "left").select("column", "category", "n_train", "category_index")


@register("proxy_column_set", sql_final(q("SELECT msno, is_churn, " + ", ".join(c for c in C.ALL_FEATURES if c not in C.PROXY_EXCLUDE)
                                          + " FROM ds"), ["cancel_rate", "auto_renew_pct", "avg_payment_plan_days",
                                                          "avg_revenue_per_txn", "discount_rate"]))
def proxy_column_set(spark, sf):
    """The proxy-controlled feature set (six label-adjacent columns dropped)."""
    ds = Chain.shared(spark, sf).dataset()
    return finalize(ds.select("msno", "is_churn", *[c for c in C.ALL_FEATURES if c not in C.PROXY_EXCLUDE]))


def _eval_row(scored: DataFrame, model: str, feature_set: str, train_rows: int, fit_s: float) -> DataFrame:
    # scored once (model transform), read by both metric passes
    scored = scored.select("is_churn", "score").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = CU.ranking_metrics(scored, "score").first()
        m = SC.classification_metrics(scored, "score", "is_churn", 0.5).first()
    finally:
        scored.unpersist()
    spark = scored.sparkSession
    return small_frame(spark,
        [(model, feature_set, r["pr_auc"], r["roc_auc"], m["precision"], m["recall"], m["f1"], m["log_loss"], m["brier"],
          int(train_rows), float(fit_s))],
        "model string, feature_set string, pr_auc double, roc_auc double, precision double, recall double, f1 double, "
        "log_loss double, brier double, train_rows bigint, fit_seconds double")


def _two_sets(spark, sf, kind, name, **kw):
    from concurrent.futures import ThreadPoolExecutor
    test = _test(spark, sf)
    _train(spark, sf)  # the shared checkpoint is built once, before the threads
    sets = list(FEATURE_SETS.items())
    # the two fits are independent Spark jobs: submitted from two driver threads
    # they share the executors instead of leaving them idle one after the other
    with ThreadPoolExecutor(max_workers=len(sets)) as pool:
        list(pool.map(lambda s: trained(spark, sf, kind, s[1], **kw), sets))
    rows = []
    for fs, ex in sets:
        tm = trained(spark, sf, kind, ex, **kw)
        rows.append(_eval_row(tm.score(test), name, fs, tm.train_rows, tm.fit_seconds))
    return finalize(rows[0].unionByName(rows[1]).drop("fit_seconds"))


@register("logreg_balanced")
def logreg_balanced(spark, sf):
    """H5: balanced logistic regression (C = 1, L2), full and proxy-controlled sets, v1 -> v2."""
    return _two_sets(spark, sf, "logistic_regression", "logistic_regression")


@register("random_forest")
def random_forest(spark, sf):
    """H6: random forest, 200 trees, depth 16, min leaf 20, sqrt features, balanced weights."""
    return _two_sets(spark, sf, "random_forest", "random_forest", trees=200, depth=16, min_leaf=20)


@register("boosted_trees")
def boosted_trees(spark, sf):
    """H7: gradient-boosted trees, 200 rounds, depth 6, step 0.1, positive weight neg/pos."""
    return _two_sets(spark, sf, "boosted_trees", "boosted_trees", trees=200, depth=6, lr=0.1)


@register("boosted_trees_config2")
def boosted_trees_config2(spark, sf):
    """H8: second boosted configuration: best-first trees of 31 leaves (depth 8 at most, 100 rows a leaf), 300 rounds,
    step 0.05, rows and columns drawn anew for each tree (0.8).  Both feature sets share their passes."""
    test, rows = _test(spark, sf), []
    for name, ex in FEATURE_SETS.items():
        tm = trained(spark, sf, "best_first", ex, **BEST_FIRST)
        rows.append(_eval_row(tm.score(test), "boosted_trees_300", name, tm.train_rows, tm.fit_seconds))
    return finalize(reduce(DataFrame.unionByName, rows).drop("fit_seconds"))


def _rule_sql():
    flag_tr = "COALESCE(CAST(t.latest_is_auto_renew AS DOUBLE), (SELECT med FROM rmed)) = 0"
    return (q(", rmed AS (SELECT COALESCE(quantile_cont(CAST(latest_is_auto_renew AS DOUBLE), 0.5), 1.0) AS med FROM sc)\n"
              "SELECT AVG(CASE WHEN COALESCE(CAST(latest_is_auto_renew AS DOUBLE), (SELECT med FROM rmed)) = 0 THEN is_churn END) AS r_off, "
              "AVG(CASE WHEN NOT (COALESCE(CAST(latest_is_auto_renew AS DOUBLE), (SELECT med FROM rmed)) = 0) THEN is_churn END) AS r_on, "
              "(SELECT med FROM rmed) AS med FROM sc", "v1"), flag_tr)


@register("rule_baseline", sql_final(
    f"WITH rates AS ({_rule_sql()[0]}), test AS ({q('SELECT msno, is_churn, latest_is_auto_renew FROM sc', 'v2')}) "
    "SELECT t.msno, t.is_churn, CASE WHEN COALESCE(CAST(t.latest_is_auto_renew AS DOUBLE), r.med) = 0 THEN r.r_off ELSE r.r_on END AS score "
    "FROM test t CROSS JOIN rates r", ["score"]))
def rule_baseline(spark, sf):
    """Auto-renew-off rule scored with the training churn rate of its group."""
    return finalize(ML.rule_baseline(_train(spark, sf), _test(spark, sf)).select("msno", "is_churn", "score"))


@register("score_customers")
def score_customers(spark, sf):
    """Full and proxy-controlled logistic scores for every v2 customer."""
    test = _test(spark, sf).select(*["msno", "is_churn"] + C.ALL_FEATURES)
    full = trained(spark, sf, "logistic_regression").score(test, "model_score_full")
    # the second model scores the first one's output: no join
    both = trained(spark, sf, "logistic_regression", C.PROXY_EXCLUDE).score(full, "model_score_proxy_controlled")
    return finalize(both.select("msno", "is_churn", "model_score_full", "model_score_proxy_controlled"))


@register("score_customers_cover", q("SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT msno) AS BIGINT) AS n_keys, "
                                     "CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_outside, "
                                     "CAST(SUM(is_churn) AS BIGINT) AS n_churned FROM sc"))
def score_customers_cover(spark, sf):
    """What must hold for any fitted model: every customer scored once, in [0, 1], labels kept."""
    s = score_customers(spark, sf)
    p, r = F.col("model_score_full"), F.col("model_score_proxy_controlled")
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("msno").alias("n_keys"),
                 F.count_if(p.isNull() | r.isNull()).alias("n_missing"),
                 F.count_if(~p.between(0, 1) | ~r.between(0, 1)).alias("n_outside"), F.sum("is_churn").cast("bigint").alias("n_churned"))


@register("driver_importance")
def driver_importance(spark, sf):
    """H26 (re-aimed): global mean |linear contribution| per source feature of the
    proxy-controlled logistic model (dummies summed back); not TreeSHAP."""
    tm = trained(spark, sf, "logistic_regression", C.PROXY_EXCLUDE)
    return finalize(ML.linear_driver_importance(tm, _test(spark, sf)))


@register("permutation_importance")
def permutation_importance(spark, sf):
    """H26(b): PR-AUC drop of the proxy-controlled random forest when a source
    feature is swapped between hash-paired rows (deterministic, bucketed)."""
    tm = trained(spark, sf, "random_forest", C.PROXY_EXCLUDE, trees=200, depth=16, min_leaf=20)
    feats = [c for c in C.ALL_FEATURES if c not in C.PROXY_EXCLUDE]
    return finalize(ML.permutation_importance(tm, _test(spark, sf), feats))


@register("top_drivers")
def top_drivers(spark, sf):
    """top five drivers by importance."""
    imp = driver_importance(spark, sf)
    return imp.orderBy(F.col("mean_abs_contribution").desc(), F.col("feature")).limit(5)


def _encoded_sql():
    num = [c for c in C.BINARY_FLAGS + C.NUMERIC_CONTINUOUS if c not in C.PROXY_EXCLUDE]
    nums = " UNION ALL ".join(f"SELECT 'num__{c}' AS encoded, '{c}' AS feature" for c in num)
    cats = _onehot_sql().replace("SELECT \"column\", category, CAST(n_train AS BIGINT) AS n_train, "
                                 "CAST(ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n_train DESC, category) - 1 AS INTEGER) "
                                 "AS category_index FROM (", "SELECT 'cat__' || \"column\" || '_' || category AS encoded, "
                                 "\"column\" AS feature FROM (")
    return f"SELECT * FROM ({cats}) c UNION ALL {nums}"


@register("encoded_to_source_feature", _encoded_sql())
def encoded_to_source_feature(spark, sf):
    """Encoded slot name -> source feature (prefix strip, dummy -> base column)."""
    return ML.encoded_to_source(trained(spark, sf, "logistic_regression", C.PROXY_EXCLUDE))


@register("driver_direction")
def driver_direction(spark, sf):
    """Decile bins of the top numeric drivers x mean contribution and mean score."""
    tm = trained(spark, sf, "logistic_regression", C.PROXY_EXCLUDE)
    test = _test(spark, sf)
    ranked = driver_importance(spark, sf).where(F.col("feature").isin(C.NUMERIC_CONTINUOUS)).orderBy(
        F.col("mean_abs_contribution").desc(), F.col("feature")).limit(6)
    feats = [r["feature"] for r in ranked.collect()]  # six names
    return finalize(reduce(DataFrame.unionByName, [ML.driver_direction(tm, test, f).withColumn("feature", F.lit(f))
                                                   for f in feats]))


BENCH_MODELS = [("logistic_regression", "logistic_regression", {}),
                ("random_forest", "random_forest", dict(trees=150, depth=16, min_leaf=20)),
                ("boosted_trees", "residual_boosting", dict(trees=200, depth=6, lr=0.1)),  # as boosted_trees: MLlib's rule
                ("boosted_trees_300", "best_first", BEST_FIRST)]


def _fit_bench(spark, sf) -> None:
    """The fits of the benchmark are independent Spark jobs: submitted together they share the cores, which one
    fit's short passes leave idle.  What fails for want of memory is tried again, and reported, by itself."""
    from concurrent.futures import ThreadPoolExecutor
    _train(spark, sf), _test(spark, sf)  # the shared stages are written before the threads

    def fit(entry):
        try:
            trained(spark, sf, entry[1], C.PROXY_EXCLUDE, **entry[2])
        except MemoryError:
            pass
    with ThreadPoolExecutor(max_workers=len(BENCH_MODELS)) as pool:
        list(pool.map(fit, BENCH_MODELS))


@register("bootstrap_models")
def bootstrap_models(spark, sf):
    """H25 over the fitted models of the benchmark and the rule: 500 paired replicates of
    PR-AUC(model) - PR-AUC(boosted trees).  One pass scores a customer under every model."""
    _fit_bench(spark, sf)
    train, scored, names = _train(spark, sf), _test(spark, sf), []
    for name, kind, kw in BENCH_MODELS:
        scored = trained(spark, sf, kind, C.PROXY_EXCLUDE, **kw).score(scored, f"p_{name}")
        names.append(name)
    scored = ML.rule_baseline(train, scored).withColumnRenamed("score", "p_rule_auto_renew_off")
    scores = {m: f"p_{m}" for m in [*names, "rule_auto_renew_off"]}
    return finalize(CU.bootstrap_pr_auc(scored.select("is_churn", *scores.values()), scores, "boosted_trees"))


def model_benchmark_frame(spark, sf) -> DataFrame:
    """Per model PR-AUC, ROC-AUC, Brier raw and after isotonic (fit on the
    calibration-fit half, evaluated on the other), precision / recall at the
    High-tier size, training rows, status."""
    ch = Chain.shared(spark, sf, "v2")
    test = CA.with_calib_split(_test(spark, sf))
    k = ch.predictions().where(F.col("risk_tier") == "High").count()
    _fit_bench(spark, sf)
    rows = []
    entries = [(name, lambda kind=kind, kw=kw: trained(spark, sf, kind, C.PROXY_EXCLUDE, **kw)) for name, kind, kw in BENCH_MODELS]
    entries.append(("rule_auto_renew_off", None))
    entries.append(("scorecard", None))
    for name, make in entries:
        try:
            if name == "rule_auto_renew_off":
                scored, n_train = ML.rule_baseline(_train(spark, sf), test), None
            elif name == "scorecard":
                scored, n_train = test.withColumn("score", F.col("risk_score_full")), None
            else:
                tm = make()
                scored, n_train = tm.score(test), tm.train_rows
            # scored once, read by every metric pass below
            scored = scored.select("is_churn", "calib_split", "score").persist(StorageLevel.MEMORY_AND_DISK)
            r = CU.ranking_metrics(scored, "score").first()
            brier = scored.agg(F.avg(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) - F.col("is_churn"), 2))).first()[0]
            iso = CA.fit_isotonic(scored.where(F.col("calib_split") == CA.FIT), "score")
            ev = CA.apply_isotonic(iso, scored.where(F.col("calib_split") == CA.EVAL), "score", "iso")
            brier_iso = ev.agg(F.avg(F.pow(F.col("iso") - F.col("is_churn"), 2))).first()[0]
            pk = CU.precision_recall_at_k(scored, "score", k).first() if k > 0 else None
            rows.append((name, "completed", r["pr_auc"], r["roc_auc"], brier, brier_iso,
                         pk["precision_at_k"] if pk else None, pk["recall_at_k"] if pk else None,
                         n_train))
            scored.unpersist()
        except MemoryError as e:  # only exhausted memory is a status, like in the original benchmark
            rows.append((name, f"not completed: {type(e).__name__}", None, None, None, None, None, None, None))
    return small_frame(spark, rows, "model string, status string, pr_auc double, roc_auc double, brier double, "
                                       "brier_after_isotonic double, precision_at_k double, recall_at_k double, "
                                       "train_rows bigint")


@register("model_benchmark")
def model_benchmark(spark, sf):
    """Benchmark table of all models on the v2 holdout."""
    return finalize(model_benchmark_frame(spark, sf))


@register("leaderboard")
def leaderboard(spark, sf):
    """completed models by PR-AUC desc, others appended last."""
    b = model_benchmark(spark, sf)
    return b.orderBy(F.when(F.col("status") == "completed", 0).otherwise(1), F.col("pr_auc").desc_nulls_last(),
                     F.col("model"))
