"""Edge rules of the scalar expressions (semantics traps T1-T18)."""

import math

from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions import expr as X


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_safe_div_zero_denominator_is_null(spark):
    assert one(spark, [(1, 0), (1, 4), (None, 2)], "a int, b int", X.safe_div("a", "b")) == [None, 0.25, None]


def test_bad_yyyymmdd_is_null_not_error(spark):
    out = one(spark, [(20170228,), (20170231,), (19700101,)], "d int", X.yyyymmdd_to_date("d").cast("string"))
    assert out == ["2017-02-28", None, "1970-01-01"]


def test_hash_uniform_matches_known_value(spark):
    # the first 8 hex digits of md5('C1-0') read as an integer (same integer in DuckDB)
    v = one(spark, [("C1-0",)], "s string", X.hash_uniform("s") * 4294967296.0)[0]
    assert int(round(v)) == 4168344688


def test_clip_keeps_null(spark):
    assert one(spark, [(1.0,), (100.0,), (None,)], "x double", X.clip_keep_null("x", 5, 80)) == [5.0, 80.0, None]


def test_buckets_are_right_closed(spark):
    e, lab = [-1, 30, 60], ["0-30", "31-60"]
    out = one(spark, [(30,), (31,), (-1,), (61,), (None,)], "x int", X.right_closed_bucket("x", e, lab))
    assert out == ["0-30", "31-60", None, None, None]


def test_risk_tier_boundaries(spark):
    out = one(spark, [(0.95,), (0.949,), (0.65,), (0.1,)], "p double", X.risk_tier("p", 0.65, 0.95))
    assert out == ["High", "Medium", "Medium", "Low"]


def test_segment_rule_null_falls_through(spark):
    rows = [("High", None, None, None, 5), ("Medium", 1, 800, 0.0, 5), ("High", 1, None, 0.2, 5), ("Low", 1, 10, 0.0, 25),
            ("Low", None, 10, 0.0, 25)]
    schema = "risk_tier string, latest_is_auto_renew int, tenure_days_at_cutoff int, discount_rate double, total_transactions int"
    out = one(spark, rows, schema, X.segment_rule())
    assert out == [C.STABLE_MONITOR, "At-Risk Veteran", "At-Risk, Price-Sensitive", C.CHAMPIONS, C.STABLE_MONITOR]


def test_priority_group_relabels_only_elevated_default(spark):
    rows = [("High", C.STABLE_MONITOR), ("Low", C.STABLE_MONITOR), ("Medium", "At-Risk Veteran")]
    out = one(spark, rows, "risk_tier string, segment string", X.priority_group())
    assert out == [C.UNMATCHED_AT_RISK, C.STABLE_MONITOR, "At-Risk Veteran"]


def test_recommend_unknown_value_tier(spark):
    rows = [("High", C.VALUE_UNKNOWN), ("High", "Medium"), ("Low", "High"), ("Low", "Low")]
    out = one(spark, rows, "risk_tier string, value_tier string", X.recommend_cell())
    assert out == [X.REC_INSUFFICIENT, X.REC_HIGH_TOUCH, X.REC_ADVOCACY, X.REC_MONITOR]


def test_key_risk_signal_null_history(spark):
    rows = [(None, None, None), (0, 5, 0.0), (1, 40, 0.0), (1, 5, 0.1), (1, 5, 0.0), (None, 40, None)]
    out = one(spark, rows, "a int, d int, c double", X.key_risk_signal("a", "d", "c"))
    assert out == ["Limited transaction history", "Auto-renew OFF", "Inactive 30+ days", "Elevated cancellation history",
                   "Multiple smaller signals", "Inactive 30+ days"]


def test_fmt_probability_never_certain(spark):
    ps = [1.0, 0.996, 0.994, 0.5, 0.006, 0.005, 0.004, 0.0, None, float("nan")]
    out = one(spark, [(p,) for p in ps], "p double", X.fmt_probability("p"))
    assert out == [">99%", ">99%", "99%", "50%", "1%", "<1%", "<1%", "<1%", "—", "—"]
    grid = one(spark, [(i / 1000,) for i in range(1001)], "p double", X.fmt_probability("p"))
    assert "0%" not in grid and "100%" not in grid


def test_fixed_format_rounds_half_even_like_python(spark):
    xs = [0.5, 2.5, 1.15, 1.05, 0.125, 1234567.5]
    out = one(spark, [(x,) for x in xs], "x double", X.py_fixed(F.col("x"), 1))
    assert out == [f"{x:.1f}" for x in xs]
    out0 = one(spark, [(x,) for x in xs], "x double", X.py_grouped(F.col("x"), 0))
    assert out0 == [f"{x:,.0f}" for x in xs]


def test_compact_count(spark):
    xs = [999.0, 1050.0, 2_500_000.0, 3_210_000_000.0]
    out = one(spark, [(x,) for x in xs], "x double", X.fmt_compact_count("x"))
    assert out == ["999", "1.1K", "2.50M", "3.21B"]


def test_feature_display_fallback(spark):
    assert one(spark, [("bd_clean",)], "f string", X.feature_display_fallback("f")) == ["Bd clean"]


def test_id_search_is_literal_and_case_insensitive(spark):
    rows = [("C+12/=",), ("c+123/=",), ("C12",), (None,)]
    out = one(spark, rows, "k string", X.id_search("k", "c+12"))
    assert out == [True, True, False, False]


def test_question_intent_first_match(spark):
    qs = ["Is a DISCOUNT worth it?", "why is she at risk", "why?", "what should we do next", "hello"]
    out = one(spark, [(t,) for t in qs], "t string", X.question_intent("t"))
    assert out == ["discount", "why_at_risk", "why_at_risk", "what_to_do", "unknown"]


def test_poisson_count_weights_have_the_mean_and_variance_of_their_count(spark):
    from ebbflow.operators.curves import poisson_count_weight
    for n, rows in ((1, 100_000), (9, 50_000), (10, 50_000), (37, 50_000), (5_000_000, 20_000)):
        df = spark.range(rows).select(poisson_count_weight(F.lit(n), F.concat(F.lit("t"), F.col("id").cast("string"))).alias("w"))
        r = df.agg(F.avg("w"), F.variance("w"), F.min("w"), F.count_if(F.col("w") != F.floor("w")), F.skewness("w")).first()
        spread = math.sqrt(n / rows)
        assert abs(r[0] - n) < 5 * spread and math.isclose(r[1], n, rel_tol=.06) and r[2] >= 0 and r[3] == 0
        assert math.isclose(r[4], 1 / math.sqrt(n), abs_tol=.1)


def test_poisson_draws_follow_their_distribution(spark):
    from collections import Counter

    from ebbflow.operators.curves import poisson_count_weight
    for n in (4, 14):
        rows = 60_000
        df = spark.range(rows).select(poisson_count_weight(F.lit(n), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("w"))
        got = Counter({int(r["w"]): r["count"] for r in df.groupBy("w").count().collect()})
        want = {k: rows * math.exp(-n + k * math.log(n) - math.lgamma(k + 1)) for k in range(60)}
        chi = sum((got[k] - e) ** 2 / e for k, e in want.items() if e >= 5)
        cells = sum(e >= 5 for e in want.values())
        assert chi < cells + 5 * math.sqrt(2 * cells)
