"""Per-customer and per-group texts equal Python's own f-string formatting."""

from pyspark.sql import functions as F

from ebbflow.operators import segments as SG
from ebbflow.operators import serving as SV


def test_deviation_sentences_match_python_formatting(spark):
    base = {"auto_renew_pct": 0.6245, "days_since_last_txn_mean": 40.5, "cancel_rate_mean": 0.0325}
    rows = [("a", 0, 100, 0.125), ("b", 1, 10, 0.0), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "msno string, latest_is_auto_renew int, days_since_last_txn int, cancel_rate double")
    got = {r["msno"]: r["deviations"] for r in SV.customer_deviations(df, base).collect()}
    exp_a = [
        f"Auto-renew is off, while {base['auto_renew_pct'] * 100:.0f}% of the population has it on -- the model's "
        "strongest general driver, associated with elevated risk for this customer.",
        f"Last transaction was {100.0:.0f} days ago, well above the {base['days_since_last_txn_mean']:.0f}-day "
        "population average.",
        f"Cancellation rate ({0.125 * 100:.1f}%) is well above the {base['cancel_rate_mean'] * 100:.1f}% population average.",
    ]
    assert got["a"] == exp_a
    assert got["b"] == [SV.DEV_NONE] and got["c"] == [SV.DEV_NONE]


def test_rationale_matches_python_formatting(spark):
    rows = [("G", 1234567, 12.345, 56.75, 9876543.5, 2319.5, 60.5, "X -- y")]
    plan = spark.createDataFrame(rows, "priority_group string, n_customers bigint, pct_of_base double, churn_rate_pct double, "
                                       "total_HRR double, median_HRR double, pct_matching_dominant_recommendation double, "
                                       "dominant_risk_value_recommendation string")
    got = plan.select(SG.rationale(plan).alias("t")).first()["t"]
    n, pct, churn, hrr, med, dom, rec = rows[0][1:]
    exp = (f"{n:,} customers ({pct:.2f}% of base) with a {churn:.1f}% actual churn rate and {hrr:,.0f} NT$ in Historical "
           f"Realized Revenue among them (median {med:,.0f} NT$/customer). {dom:.0f}% of this group falls into the "
           f"'{rec}' cell of the risk x value framework, which sets the "
           f"recommended intensity below.")
    assert got == exp


def test_score_range_labels(spark):
    from ebbflow.functions.expr import score_range_label
    # the rule prints "[lo, hi)" whenever hi < 1.01 - including the High tier's 1.0001 edge
    rows = [(0.95, 1.0001), (0.65, 0.95), (0.0, 0.65), (0.9, 1.5)]
    df = spark.createDataFrame(rows, "lo double, hi double")
    got = [r[0] for r in df.select(score_range_label("lo", "hi")).collect()]
    assert got == [f"[{lo:.2f}, {hi:.2f})" if hi < 1.01 else f"[{lo:.2f}, 1.00]" for lo, hi in rows]
