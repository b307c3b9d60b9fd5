"""Queries behind the manager-facing tools (B21-B27, B29-B33, C5, C10-C12, D26-D28,
D32, D35, D39, F1, F2): every tool is a filter / top-k / aggregate over the
customer lookup table, returned as a DataFrame.  Population baselines and
champion figures are fixed-size results (a handful of scalars) passed back as
literals, so no cross join is planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions import ranged as RA

from ebbflow import config as C
from ebbflow.functions.expr import (id_search, key_risk_signal, priority_group, range_keep_null)

# Short action verb per priority group.
SHORT_ACTION_BY_SEGMENT = {
    "At-Risk, Auto-Renew Off": "Re-engage",
    "At-Risk Veteran": "Loyalty outreach",
    "At-Risk Newcomer": "Onboarding nudge",
    "At-Risk, Price-Sensitive": "Pricing conversation",
    "Unmatched At-Risk (no segment)": "Standard outreach",
    "Engaged Low-Risk (Champions)": "Upsell / advocacy",
    "Stable / Monitor": "Monitor only",
}

# Why a segment is approached, in one sentence.
SHORT_WHY_BY_SEGMENT = {
    "At-Risk, Auto-Renew Off": "Customer subscription state indicates elevated retention risk.",
    "At-Risk Veteran": "Long-tenured customer showing risk signals despite auto-renew being on.",
    "At-Risk Newcomer": "New customer (under 6 months) already showing elevated risk.",
    "At-Risk, Price-Sensitive": "Heavy historical discount usage alongside elevated risk.",
    "Unmatched At-Risk (no segment)": "Elevated risk without a clear single driver -- treated with the standard tier-based playbook.",
    "Engaged Low-Risk (Champions)": "Low risk and high historical value -- a growth, not retention, case.",
    "Stable / Monitor": "Low risk and no standout value signal to act on.",
}

# What to avoid with a segment.
AVOID_BY_SEGMENT = {
    "At-Risk, Auto-Renew Off": "Don't lead with a discount -- the framework's highest-leverage response here is a low-cost auto-renew nudge, not a price concession.",
    "At-Risk Veteran": "Avoid a generic acquisition-style script -- this is a long-tenured customer with auto-renew already on; treat as loyalty/appreciation outreach, not a new-customer pitch.",
    "At-Risk Newcomer": "Avoid leading with a discount -- this group is defined by short tenure (under 6 months), not by discount usage, so the framework's play here is onboarding support rather than a price concession.",
    "At-Risk, Price-Sensitive": "Avoid a high-touch, high-cost campaign -- this segment's defining signal is discount usage, so the framework calls for a pricing/plan-fit conversation, not premium outreach.",
    "Unmatched At-Risk (no segment)": "Avoid a specialized script -- this customer didn't match any defined segment pattern, so the standard tier-based playbook applies, not a customized one.",
    "Engaged Low-Risk (Champions)": "Avoid retention spend entirely -- this is a growth/advocacy case, not a churn risk, per the framework.",
    "Stable / Monitor": "Avoid proactive outreach -- no risk or value signal currently in the framework justifies spend on this customer.",
}

# Display names of model features.
FEATURE_DISPLAY_NAMES = {
    "latest_is_auto_renew": "Auto-renew status (most recent)",
    "first_transaction_date": "Date of first transaction",
    "txn_span_days": "Days between first and last transaction",
    "latest_payment_method_id": "Payment method (most recent)",
    "total_auto_renew": "Historical auto-renew count",
    "cancel_rate": "Cancellation rate",
    "latest_plan_list_price": "List price (most recent plan)",
    "total_transactions": "Total number of transactions",
    "latest_actual_amount_paid": "Amount paid (most recent transaction)",
    "total_cancellations": "Total cancellations",
    "total_revenue": "Total historical revenue",
    "avg_revenue_per_txn": "Average revenue per transaction",
    "tenure_days_at_cutoff": "Tenure (days)",
    "total_list_price": "Total list price (pre-discount)",
    "registration_init_time": "Registration date",
    "auto_renew_pct": "Share of transactions with auto-renew on",
    "days_since_last_txn": "Days since last transaction",
    "discount_rate": "Average discount rate",
}

# Customer deviation sentences (numbers filled in per customer).
DEV_AUTO_RENEW = ("Auto-renew is off, while {pct}% of the population has it on -- the model's strongest general "
                  "driver, associated with elevated risk for this customer.")
DEV_RECENCY = "Last transaction was {days} days ago, well above the {mean}-day population average."
DEV_CANCEL = "Cancellation rate ({rate}%) is well above the {mean}% population average."
DEV_NONE = ("No single behavioral flag stands out sharply from the population average -- the Model Risk Score "
            "reflects a combination of smaller signals, not one dominant factor.")

LOOKUP_COLUMNS = ["msno", "is_churn", "risk_tier", "segment", "segment_file_label", *C.CHAR_COLS, "risk_score_full",
                  "total_revenue", "value_tier", "calibrated_probability"]


def _map(d: dict, c: Column, default: str | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    v = F.element_at(m, c)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def customer_360(chain) -> DataFrame:
    """Segments + risk score + value tier + calibrated probability, with the
    residual relabel (B18).  Every stage derives per customer from the same base
    rows, so the 'joins' of the original are one narrow lineage here."""
    from ebbflow.operators import segments as SG
    cal = chain.calibrated()
    seg = SG.assign_segments(cal)
    e1, e2 = chain.tercile_edges
    vt = SG.assign_value_tiers(seg, e1, e2)
    return vt.select(
        "msno", "is_churn", "risk_tier", priority_group("risk_tier", "segment").alias("segment"),
        F.col("segment").alias("segment_file_label"), *C.CHAR_COLS, "risk_score_full", "total_revenue", "value_tier",
        "calibrated_probability")


def with_signal_and_action(df: DataFrame) -> DataFrame:
    """B21 + F1 columns: key risk signal and the short action; residual rows marked '†'."""
    gap = F.col("risk_tier").isin(*C.ELEVATED_TIERS) & (F.col("segment_file_label") == C.STABLE_MONITOR)
    action = _map(SHORT_ACTION_BY_SEGMENT, F.col("segment"), "Standard outreach")
    return df.withColumn("key_risk_signal", key_risk_signal()).withColumn(
        "recommended_action", F.when(gap, F.concat(action, F.lit(" †"))).otherwise(action))


def top_k(df: DataFrame, k: int, sort_by: str = "risk_score_full", ascending: bool = False) -> DataFrame:
    """Sort + limit with a deterministic tie-break (key); plans as TakeOrderedAndProject."""
    o = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
    return df.orderBy(o, F.col("msno")).limit(k)


def priority_queue(lookup: DataFrame, risk_tiers=("High", "Medium"), value_tiers=(), segments=(), search: str = "",
                   max_rows: int = C.QUEUE_CAP) -> DataFrame:
    """F1: page filters -> top 500 by score -> signal and action columns."""
    f = filter_lookup(lookup, risk_tiers, value_tiers, segments, search)
    q = top_k(f, max_rows)
    return with_signal_and_action(q).select("msno", "risk_tier", "value_tier", "risk_score_full", "key_risk_signal",
                                           "recommended_action")


def filter_lookup(lookup: DataFrame, risk_tiers=(), value_tiers=(), segments=(), search: str = "") -> DataFrame:
    f = lookup
    if search:
        f = f.where(id_search("msno", search))
    if risk_tiers:
        f = f.where(F.col("risk_tier").isin(*risk_tiers))
    if value_tiers:
        f = f.where(F.col("value_tier").isin(*value_tiers))
    if segments:
        f = f.where(F.col("segment").isin(*segments))
    return f


class SearchError(ValueError):
    pass


SORTABLE = ("risk_score_full", "calibrated_probability", "total_revenue")


def search_customers(lookup: DataFrame, *, risk_tier=None, value_tier=None, segment=None, min_risk_score=None,
                     max_risk_score=None, min_calibrated_probability=None, max_calibrated_probability=None,
                     min_hrr=None, max_hrr=None, auto_renew: bool | None = None, sort_by: str = "risk_score_full",
                     ascending: bool = False, limit: int = 20) -> tuple[int, DataFrame]:
    """Validated arguments -> predicate list -> (total_matches, top rows).
    Range bounds are inclusive; ``limit`` is capped at 200 (the tool's own cap)."""
    if sort_by not in SORTABLE:
        raise SearchError(f"sort_by must be one of {SORTABLE}")
    if limit <= 0:
        raise SearchError("limit must be a positive integer")
    limit = min(limit, C.SEARCH_CAP)

    def as_list(v):
        return None if v is None else ([v] if isinstance(v, str) else list(v))

    tiers, values, segs = as_list(risk_tier), as_list(value_tier), as_list(segment)
    for vals, allowed, what in [(tiers, C.TIER_ORDER, "risk_tier"),
                                (values, C.TIER_ORDER + [C.VALUE_UNKNOWN], "value_tier"),
                                (segs, C.GROUP_ORDER, "segment")]:
        if vals and [v for v in vals if v not in allowed]:
            raise SearchError(f"unknown {what} value(s): {[v for v in vals if v not in allowed]}")
    preds = []
    if tiers:
        preds.append(F.col("risk_tier").isin(*tiers))
    if values:
        preds.append(F.col("value_tier").isin(*values))
    if segs:
        preds.append(F.col("segment").isin(*segs))
    for col, lo, hi in [("risk_score_full", min_risk_score, max_risk_score),
                        ("calibrated_probability", min_calibrated_probability, max_calibrated_probability),
                        ("total_revenue", min_hrr, max_hrr)]:
        if lo is not None:
            preds.append(F.col(col) >= F.lit(lo))
        if hi is not None:
            preds.append(F.col(col) <= F.lit(hi))
    if auto_renew is not None:
        preds.append(F.col("latest_is_auto_renew") == int(auto_renew))
    f = lookup
    for p in preds:
        f = f.where(p)
    total = f.count()
    rows = with_signal_and_action(top_k(f, limit, sort_by, ascending)).select(
        "msno", "risk_tier", "value_tier", F.col("risk_score_full").alias("model_risk_score"),
        "calibrated_probability", F.col("total_revenue").cast("double").alias("historical_realized_revenue_ntd"),
        "segment", "key_risk_signal",
        _map(SHORT_ACTION_BY_SEGMENT, F.col("segment"), "Standard outreach").alias("recommended_action"))
    return total, rows


def population_baselines(lookup: DataFrame) -> DataFrame:
    """Population means and median tenure (one row)."""
    means = lookup.agg(
        F.avg("latest_is_auto_renew").alias("auto_renew_pct"), F.avg("total_transactions").alias("total_transactions_mean"), F.avg("cancel_rate").alias("cancel_rate_mean"),
        F.avg("discount_rate").alias("discount_rate_mean"), F.avg("days_since_last_txn").alias("days_since_last_txn_mean"))
    # one row each
    row = RA.quantile_row(lookup, {"m": ("tenure_days_at_cutoff", 0.5)})
    median = F.lit(None if row is None else row["m"]).cast("double")
    return means.select("auto_renew_pct", median.alias("tenure_days_median"), "total_transactions_mean", "cancel_rate_mean",
                        "discount_rate_mean", "days_since_last_txn_mean")


def _fill(template: str, **parts: Column) -> Column:
    """Concatenate a fixed sentence with formatted number columns in its slots."""
    import re
    pieces, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(parts[m.group(1)])
        pos = m.end()
    pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def customer_deviations(lookup: DataFrame, base: dict) -> DataFrame:
    """Per customer the deviation sentences vs the population (auto-renew off,
    recency > 1.5 x mean, cancel rate > 1.5 x mean), default sentence if none."""
    from ebbflow.functions.expr import py_fixed
    k = C.DEVIATION_FACTOR
    s1 = F.when(F.col("latest_is_auto_renew") == 0,
                _fill(DEV_AUTO_RENEW, pct=py_fixed(F.lit(base["auto_renew_pct"] * 100), 0)))
    s2 = F.when(F.col("days_since_last_txn") > F.lit(base["days_since_last_txn_mean"] * k),
                _fill(DEV_RECENCY, days=py_fixed(F.col("days_since_last_txn").cast("double"), 0),
                      mean=py_fixed(F.lit(base["days_since_last_txn_mean"]), 0)))
    s3 = F.when(F.col("cancel_rate") > F.lit(base["cancel_rate_mean"] * k),
                _fill(DEV_CANCEL, rate=py_fixed(F.col("cancel_rate") * 100, 1),
                      mean=py_fixed(F.lit(base["cancel_rate_mean"] * 100), 1)))
    arr = F.filter(F.array(s1, s2, s3), lambda x: x.isNotNull())
    return lookup.select("msno", F.when(F.size(arr) == 0, F.array(F.lit(DEV_NONE))).otherwise(arr).alias("deviations"))


def recommendations(plan: DataFrame) -> DataFrame:
    """The recommendation of each priority group from its action-plan row: action, objective,
    intensity, rationale, why and what to avoid."""
    g = F.col("priority_group")
    return plan.select(
        g.alias("segment"), _map(SHORT_ACTION_BY_SEGMENT, g, "Standard outreach").alias("recommended_action"),
        F.col("marketing_objective").alias("objective"), "intervention_intensity", "rationale",
        _map(SHORT_WHY_BY_SEGMENT, g, "Elevated model risk for this segment.").alias("why"),
        _map(AVOID_BY_SEGMENT, g, "").alias("avoid"))


def customer_recommendations(lookup: DataFrame, recommended: DataFrame) -> DataFrame:
    """The recommendation of each customer's segment (seven rows, broadcast)."""
    return lookup.select("msno", "segment").join(
        F.broadcast(recommended.select("segment", "recommended_action", "intervention_intensity", "why", "avoid")), "segment", "left")


def compare_customers_to_champions(lookup: DataFrame, champions) -> DataFrame:
    """C12 for customers: each one's calibrated probability and revenue beside the Champions' churn
    rate and median revenue (one row, given)."""
    return lookup.select(
        "msno", F.col("calibrated_probability").alias("subject_calibrated_probability"),
        F.col("total_revenue").cast("double").alias("subject_hrr"),
        F.lit(champions["champions_churn_rate_pct"]).cast("double").alias("champions_churn_rate_pct"),
        F.lit(champions["champions_median_hrr"]).cast("double").alias("champions_median_hrr"))


def kpi_metrics(lookup: DataFrame) -> DataFrame:
    """D26 + D27: headline counts and revenue in one conditional aggregation."""
    high = F.col("risk_tier") == "High"
    known = F.col("value_tier") != C.VALUE_UNKNOWN
    return lookup.agg(
        F.count(F.lit(1)).alias("n_customers_scored"),
        (F.avg(F.col("is_churn").cast("double")) * 100.0).alias("overall_churn_rate_pct"),
        F.count_if(high).alias("high_risk_customers"),
        F.count_if(F.col("risk_tier") == "Medium").alias("medium_risk_customers"),
        F.count_if(F.col("risk_tier") == "Low").alias("low_risk_customers"),
        F.count_if(F.col("risk_tier").isin(*C.ELEVATED_TIERS)).alias("elevated_risk_customers"),
        F.count_if(high & (F.col("value_tier") == "High")).alias("high_risk_high_value_customers"),
        F.sum(F.when(known, F.col("total_revenue"))).cast("bigint").alias("total_realized_revenue"),
        F.sum(F.when(high & known, F.col("total_revenue"))).cast("bigint").alias("high_risk_revenue_exposure"))


def revenue_exposure(lookup: DataFrame) -> DataFrame:
    """100 %-weight exposure of the High tier vs the score-weighted sum."""
    high = (F.col("risk_tier") == "High") & (F.col("value_tier") != C.VALUE_UNKNOWN)
    rev = F.col("total_revenue").cast("double")
    return lookup.agg(
        F.count_if(F.col("risk_tier") == "High").alias("n_high"),
        F.sum(F.when(high, rev)).alias("exposure_100pct"),
        F.sum(F.when(high, rev * F.col("risk_score_full"))).alias("score_weighted"),
        F.sum(F.when(high, rev * F.col("calibrated_probability"))).alias("calibrated_weighted"),
    ).withColumn("difference", F.col("exposure_100pct") - F.col("calibrated_weighted"))


def queue_composition(queue_rows: DataFrame) -> DataFrame:
    """Counts by risk x value in a filtered list."""
    return queue_rows.groupBy("risk_tier", "value_tier").agg(F.count(F.lit(1)).alias("n"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["range_keep_null", "Window"]
