"""Leakage-safe customer feature table for one cutoff.

Plan shape: the cutoff predicate and the column list reach the Parquet scan;
counts, sums, min/max, the distinct payment-method count and the latest row are
one hash aggregate (partial + final, one shuffle on ``msno``); member features
are a narrow projection; the label table is left-joined to both on ``msno``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions.expr import day_diff, safe_div, yyyymmdd_to_date

TXN_COLUMNS = ["msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid",
               "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel"]
LATEST_COLUMNS = [("payment_method_id", "latest_payment_method_id"),
                  ("payment_plan_days", "latest_payment_plan_days"),
                  ("plan_list_price", "latest_plan_list_price"),
                  ("actual_amount_paid", "latest_actual_amount_paid"),
                  ("is_auto_renew", "latest_is_auto_renew"),
                  ("is_cancel", "latest_is_cancel"),
                  ("membership_expire_date", "latest_membership_expire_date")]

TXN_FEATURE_COLUMNS = [
    "msno", "total_transactions", "total_cancellations", "total_auto_renew", "total_revenue",
    "total_list_price", "first_transaction_date", "last_transaction_date", "num_distinct_payment_methods",
    "latest_payment_method_id", "latest_payment_plan_days", "latest_plan_list_price",
    "latest_actual_amount_paid", "latest_is_auto_renew", "latest_is_cancel", "latest_membership_expire_date",
    "cancel_rate", "auto_renew_pct", "avg_payment_plan_days", "avg_revenue_per_txn", "total_discount",
    "discount_rate", "membership_expire_date_invalid", "txn_span_days", "days_since_last_txn",
    "membership_remaining_days",
]
MEMBER_FEATURE_COLUMNS = ["msno", "city", "bd_clean", "bd_missing", "gender", "gender_missing",
                          "registered_via", "registered_via_missing", "registration_init_time",
                          "registration_year", "registration_month", "tenure_days_at_cutoff"]


def cutoff_filter(txn: DataFrame, cutoff: int) -> DataFrame:
    """B1: the leakage boundary, pushed into the scan as a Parquet filter."""
    return txn.where(F.col("transaction_date") <= F.lit(cutoff))


def raw_scan_stats(txn: DataFrame, cutoff: int) -> DataFrame:
    """Count, min/max date and the rows kept by the cutoff in one scan."""
    return txn.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.min("transaction_date").alias("raw_min_date"),
        F.max("transaction_date").alias("raw_max_date"),
        F.count_if(F.col("transaction_date") <= F.lit(cutoff)).alias("n_used"),
    )


def transaction_aggregates(txn: DataFrame, cutoff: int, tie_break: str | None = "txn_id") -> DataFrame:
    """D1 + D3 + E1 in one aggregation.  The latest row is ``max_by`` over a
    (date, tie-break) struct: partial-aggregatable, so a key holding a third of
    all rows is combined map-side instead of being sorted in one task.  The
    distinct payment-method count is ``size(collect_set)`` - the set is bounded
    by the number of payment codes (tens), so no Expand/double shuffle."""
    cols = TXN_COLUMNS + ([tie_break] if tie_break else [])
    t = cutoff_filter(txn.select(*cols), cutoff)
    order_key = F.struct("transaction_date", tie_break) if tie_break else F.col("transaction_date")
    latest = F.max_by(F.struct(*[F.col(src).alias(dst) for src, dst in LATEST_COLUMNS]), order_key)
    return t.groupBy("msno").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("is_cancel").cast("bigint").alias("total_cancellations"),
        F.sum("is_auto_renew").cast("bigint").alias("total_auto_renew"),
        F.sum("payment_plan_days").cast("bigint").alias("sum_payment_plan_days"),
        F.sum("actual_amount_paid").cast("bigint").alias("total_revenue"),
        F.sum("plan_list_price").cast("bigint").alias("total_list_price"),
        F.min("transaction_date").cast("int").alias("first_transaction_date"),
        F.max("transaction_date").cast("int").alias("last_transaction_date"),
        F.size(F.collect_set("payment_method_id")).cast("bigint").alias("num_distinct_payment_methods"),
        latest.alias("latest"),
    ).select("*", "latest.*").drop("latest")


def transaction_features(txn: DataFrame, cutoff: int, tie_break: str | None = "txn_id",
                         expire_floor: int = C.EXPIRE_DATE_MIN_VALID) -> DataFrame:
    """Per paying customer: aggregates, latest values, safe ratios (B6), total
    discount (B7), expire-date sentinel guard (B5) and day differences (B9)."""
    return features_of(transaction_aggregates(txn, cutoff, tie_break), cutoff, expire_floor)


def features_of(a: DataFrame, cutoff: int, expire_floor: int = C.EXPIRE_DATE_MIN_VALID) -> DataFrame:
    """The feature columns over the aggregates of each customer at the cutoff."""
    expire_invalid = F.col("latest_membership_expire_date") < F.lit(expire_floor)
    cut = F.lit(cutoff)
    return a.select(
        "msno", "total_transactions", "total_cancellations", "total_auto_renew", "total_revenue",
        "total_list_price", "first_transaction_date", "last_transaction_date", "num_distinct_payment_methods",
        *[dst for _, dst in LATEST_COLUMNS],
        safe_div("total_cancellations", "total_transactions").alias("cancel_rate"),
        safe_div("total_auto_renew", "total_transactions").alias("auto_renew_pct"),
        safe_div("sum_payment_plan_days", "total_transactions").alias("avg_payment_plan_days"),
        safe_div("total_revenue", "total_transactions").alias("avg_revenue_per_txn"),
        (F.col("total_list_price") - F.col("total_revenue")).alias("total_discount"),
        safe_div(F.col("total_list_price") - F.col("total_revenue"), "total_list_price").alias("discount_rate"),
        expire_invalid.cast("int").alias("membership_expire_date_invalid"),
        day_diff("last_transaction_date", "first_transaction_date").alias("txn_span_days"),
        day_diff(cut, "last_transaction_date").alias("days_since_last_txn"),
        F.when(~expire_invalid, day_diff("latest_membership_expire_date", cut)).alias("membership_remaining_days"),
    )


def member_features(members: DataFrame, cutoff: int) -> DataFrame:
    """Cleaned demographics and tenure at the cutoff.  Narrow:
    no shuffle."""
    bd_invalid = F.coalesce((F.col("bd") < C.BD_MIN_VALID) | (F.col("bd") > C.BD_MAX_VALID), F.lit(False))
    reg = yyyymmdd_to_date("registration_init_time")
    return members.select(
        "msno",
        F.col("city").cast("int").alias("city"),
        F.when(~bd_invalid, F.col("bd")).cast("int").alias("bd_clean"),
        bd_invalid.cast("int").alias("bd_missing"),
        "gender",
        F.col("gender").isNull().cast("int").alias("gender_missing"),
        F.col("registered_via").cast("int").alias("registered_via"),
        F.coalesce(F.col("registered_via") == C.REGISTERED_VIA_UNKNOWN, F.lit(False)).cast("int")
        .alias("registered_via_missing"),
        F.col("registration_init_time").cast("int").alias("registration_init_time"),
        F.year(reg).alias("registration_year"),
        F.month(reg).alias("registration_month"),
        F.datediff(yyyymmdd_to_date(F.lit(cutoff)), reg).alias("tenure_days_at_cutoff"),
    )


def join_with_indicator(left: DataFrame, right: DataFrame, flag: str, key: str = "msno") -> DataFrame:
    """Left join with a presence flag taken from a marker column (not from
    NULL payload columns)."""
    marked = right.withColumn("_present", F.lit(1))
    return (left.join(marked, key, "left")
            .withColumn(flag, F.coalesce(F.col("_present"), F.lit(0)).cast("int")).drop("_present"))


def zero_fill_counts(df: DataFrame) -> DataFrame:
    """Only the four count columns become 0; ratios/dates stay NULL."""
    return df.fillna(0, subset=C.ZERO_FILL_COUNTS)


MODELING_COLUMNS = ["msno", "is_churn"] + MEMBER_FEATURE_COLUMNS[1:] + ["has_members_data"] + \
    TXN_FEATURE_COLUMNS[1:] + ["has_transactions_data"]


def modeling_dataset(labels: DataFrame, members: DataFrame, txn: DataFrame, cutoff: int,
                     tie_break: str | None = "txn_id", expire_floor: int = C.EXPIRE_DATE_MIN_VALID) -> DataFrame:
    """C4: labels left-joined to member and transaction features (40 columns)."""
    return assemble(labels, member_features(members, cutoff), transaction_features(txn, cutoff, tie_break, expire_floor))


def assemble(labels: DataFrame, mf: DataFrame, tf: DataFrame) -> DataFrame:
    """Labels beside the features of members and transactions."""
    df = join_with_indicator(labels.select("msno", "is_churn"), mf, "has_members_data")
    df = join_with_indicator(df, tf, "has_transactions_data")
    return zero_fill_counts(df).select(*MODELING_COLUMNS)
