"""In-job quality checks as DataFrames.

Each check is one aggregation producing a small long table; ``raise_on_fail``
turns a FAIL row into an exception inside the job that produced it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityCheckFailed(AssertionError):
    pass


def _long(df1row: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """(check, value column, status column) triples of a one-row frame -> long table, in one scan."""
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(v).cast("double").alias("value"), F.col(s).alias("status"))
                     for name, v, s in checks])
    return df1row.select(F.explode(rows).alias("_c")).select("_c.*")


def sanity_checks(labels: DataFrame, dataset: DataFrame, cutoff: int) -> DataFrame:
    """Row count preserved, key unique, churn rate (5-15 % band warns),
    max last date <= cutoff, coverage, min/max/mean of two day columns."""
    n_labels = labels.count()  # one scalar
    d = dataset.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("msno").alias("n_keys"),
        F.avg("is_churn").alias("churn_rate"), F.max("last_transaction_date").alias("max_last"),
        F.avg("has_members_data").alias("cov_members"), F.avg("has_transactions_data").alias("cov_txn"),
        F.min("membership_remaining_days").alias("mrd_min"), F.max("membership_remaining_days").alias("mrd_max"),
        F.avg("membership_remaining_days").alias("mrd_mean"), F.min("tenure_days_at_cutoff").alias("ten_min"),
        F.max("tenure_days_at_cutoff").alias("ten_max"), F.avg("tenure_days_at_cutoff").alias("ten_mean"))
    s = d.withColumn("n_labels", F.lit(n_labels)).select(
        "*",
        F.when(F.col("n_rows") == F.col("n_labels"), "PASS").otherwise("FAIL").alias("s_rows"),
        F.when(F.col("n_rows") == F.col("n_keys"), "PASS").otherwise("FAIL").alias("s_keys"),
        F.when(F.col("churn_rate").between(0.05, 0.15) & (F.col("churn_rate") != 0.05) & (F.col("churn_rate") != 0.15),
               "PASS").otherwise("WARN").alias("s_churn"),
        F.when(F.coalesce(F.col("max_last") <= F.lit(cutoff), F.lit(True)), "PASS").otherwise("FAIL").alias("s_leak"),
        F.lit("INFO").alias("s_info"))
    return _long(s, [("row_count_preserved", "n_rows", "s_rows"), ("key_unique", "n_keys", "s_keys"),
                     ("churn_rate", "churn_rate", "s_churn"), ("max_last_transaction_date", "max_last", "s_leak"),
                     ("coverage_members", "cov_members", "s_info"), ("coverage_transactions", "cov_txn", "s_info"),
                     ("membership_remaining_days_min", "mrd_min", "s_info"),
                     ("membership_remaining_days_max", "mrd_max", "s_info"),
                     ("membership_remaining_days_mean", "mrd_mean", "s_info"),
                     ("tenure_days_at_cutoff_min", "ten_min", "s_info"),
                     ("tenure_days_at_cutoff_max", "ten_max", "s_info"),
                     ("tenure_days_at_cutoff_mean", "ten_mean", "s_info")])


def raise_on_fail(checks: DataFrame) -> DataFrame:
    """Raise when any row has status FAIL (the check table is a few rows)."""
    failed = [r["check"] for r in checks.where(F.col("status") == "FAIL").select("check").collect()]
    if failed:
        raise QualityCheckFailed(f"quality checks failed: {failed}")
    return checks


def aligned_lookup(holdout: DataFrame, stored: DataFrame) -> DataFrame:
    """Cover, duplicate keys and label mismatches of stored predictions against the holdout."""
    per_key = stored.groupBy("msno").agg(F.count(F.lit(1)).alias("_k"), F.max("is_churn").alias("p_churn"))
    dup = per_key.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("d")).first()["d"]
    j = holdout.select("msno", "is_churn").join(per_key, "msno", "left")
    return j.agg(F.count(F.lit(1)).alias("n_holdout"), F.count("_k").alias("n_matched"),
                 F.lit(dup).cast("bigint").alias("n_duplicate_keys"), F.count_if(F.col("_k").isNull()).alias("n_missing"),
                 F.count_if(F.col("p_churn") != F.col("is_churn")).alias("n_label_mismatch"))


def cleaning_counts(mf: DataFrame, tf: DataFrame) -> DataFrame:
    """Invalid age, unknown channel, future registration, missing gender,
    sentinel expire dates - counts and percentages, one row."""
    m = mf.agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("bd_missing").cast("bigint").alias("n_bd_invalid"),
        F.sum("registered_via_missing").cast("bigint").alias("n_via_unknown"),
        F.count_if(F.col("tenure_days_at_cutoff") < 0).alias("n_future_registration"),
        F.sum("gender_missing").cast("bigint").alias("n_gender_missing"))
    t = tf.agg(F.sum("membership_expire_date_invalid").cast("bigint").alias("n_expire_invalid"),
               F.count(F.lit(1)).alias("n_txn_customers")).first()  # two scalars
    m = m.withColumn("n_expire_invalid", F.lit(t["n_expire_invalid"]).cast("bigint")) \
         .withColumn("n_txn_customers", F.lit(t["n_txn_customers"]).cast("bigint"))
    return m.select(
        "n_members", "n_bd_invalid", (F.col("n_bd_invalid") * 100.0 / F.col("n_members")).alias("pct_bd_invalid"),
        "n_via_unknown", (F.col("n_via_unknown") * 100.0 / F.col("n_members")).alias("pct_via_unknown"),
        "n_future_registration", "n_gender_missing", "n_expire_invalid",
        (F.col("n_expire_invalid") * 100.0 / F.col("n_txn_customers")).alias("pct_expire_invalid"))


def label_rate_shift(union: DataFrame) -> DataFrame:
    """Per round rows, churn rate, member and transaction coverage."""
    return union.groupBy("round").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("is_churn").alias("churn_rate"),
        F.avg("has_members_data").alias("member_coverage"), F.avg("has_transactions_data").alias("txn_coverage"))


def population_overlap(a: DataFrame, b: DataFrame, key: str = "msno") -> DataFrame:
    """Keys in both rounds (inner join) and in one only (anti joins)."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(True))
    kb = b.select(key).distinct().withColumn("_b", F.lit(True))
    j = ka.join(kb, key, "full")  # one shuffle per side on the key
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.agg(F.count_if(in_a).alias("n_v1"), F.count_if(in_b).alias("n_v2"),
                 F.count_if(in_a & in_b).alias("n_both"), F.count_if(in_a & ~in_b).alias("n_only_v1"),
                 F.count_if(in_b & ~in_a).alias("n_only_v2"))


MEMBER_BLOCK = ["city", "gender_missing", "registered_via", "registration_init_time", "registration_year",
                "registration_month", "tenure_days_at_cutoff", "bd_missing", "registered_via_missing"]
TXN_BLOCK = ["total_revenue", "total_list_price", "first_transaction_date", "last_transaction_date",
             "latest_payment_method_id", "latest_payment_plan_days", "latest_plan_list_price",
             "latest_actual_amount_paid", "latest_is_auto_renew", "latest_is_cancel",
             "latest_membership_expire_date", "cancel_rate", "auto_renew_pct", "avg_payment_plan_days",
             "avg_revenue_per_txn", "total_discount", "membership_expire_date_invalid", "txn_span_days",
             "days_since_last_txn"]


def _null_count(cols: list[str]):
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def missing_blocks(ds: DataFrame) -> DataFrame:
    """Per presence-flag combination, min/max of the per-row NULL counts of
    the member block and the transaction block (columns with a second NULL cause
    - bd_clean, gender, discount_rate, membership_remaining_days - excluded)."""
    return (ds.select("has_members_data", "has_transactions_data",
                      _null_count(MEMBER_BLOCK).alias("m_nulls"), _null_count(TXN_BLOCK).alias("t_nulls"))
            .groupBy("has_members_data", "has_transactions_data")
            .agg(F.count(F.lit(1)).alias("n_customers"), F.min("m_nulls").alias("min_member_nulls"),
                 F.max("m_nulls").alias("max_member_nulls"), F.min("t_nulls").alias("min_txn_nulls"),
                 F.max("t_nulls").alias("max_txn_nulls")))


def exact_redundancies(ds: DataFrame) -> DataFrame:
    """Identities that hold row by row; violations and rows checked per identity."""
    first = F.try_to_date(F.col("first_transaction_date").cast("string"), "yyyyMMdd")
    last = F.try_to_date(F.col("last_transaction_date").cast("string"), "yyyyMMdd")
    ids = [
        ("total_discount = list - revenue", F.col("total_discount") != F.col("total_list_price") - F.col("total_revenue"),
         "total_discount"),
        ("txn_span = last - first", F.col("txn_span_days") != F.datediff(last, first), "txn_span_days"),
        ("avg_revenue_per_txn = revenue / transactions",
         F.abs(F.col("avg_revenue_per_txn") * F.col("total_transactions") - F.col("total_revenue"))
         > 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col("total_revenue").cast("double"))), "avg_revenue_per_txn"),
        ("cancel_rate = cancellations / transactions",
         F.abs(F.col("cancel_rate") * F.col("total_transactions") - F.col("total_cancellations")) > 1e-6, "cancel_rate"),
        ("auto_renew_pct = auto_renew / transactions",
         F.abs(F.col("auto_renew_pct") * F.col("total_transactions") - F.col("total_auto_renew")) > 1e-6,
         "auto_renew_pct"),
    ]
    aggs = []
    for i, (_, bad, present) in enumerate(ids):
        aggs += [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"v{i}"), F.count(present).alias(f"c{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("identity"), F.col(f"v{i}").alias("n_violations"), F.col(f"c{i}").alias("n_checked"))
                     for i, (name, _, _) in enumerate(ids)])
    return ds.agg(*aggs).select(F.explode(rows).alias("_i")).select("_i.*")  # one pass, then five rows


def attach_with_completeness(left: DataFrame, right: DataFrame, cols: list[str], key: str = "msno") -> DataFrame:
    """Left join, then a completeness count of keys that found no match."""
    j = left.join(right.select(key, *cols), key, "left")
    return j


def completeness(joined: DataFrame, col: str) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(col).isNull()).alias("n_missing"))


def reconcile_labels(stored: DataFrame, resolved: DataFrame, key: str = "msno", label: str = "label") -> DataFrame:
    """C14: stored vs resolved labels: rows on each side and mismatches."""
    j = stored.select(key, F.col(label).alias("stored")).join(resolved.select(key, F.col(label).alias("resolved")),
                                                              key, "full")
    return j.agg(F.count("stored").alias("n_stored"), F.count("resolved").alias("n_resolved"),
                 F.count_if(F.col("stored").isNull() | F.col("resolved").isNull()).alias("n_unpaired"),
                 F.count_if(F.col("stored") != F.col("resolved")).alias("n_mismatch"))


def reproduction_check(recomputed: DataFrame, stored: DataFrame, on: str, metric: str, tol: float) -> DataFrame:
    """Recomputed metric beside a stored one, difference and pass flag."""
    j = recomputed.select(on, F.col(metric).alias("recomputed")).join(
        stored.select(on, F.col(metric).alias("stored")), on, "full")
    return j.select(on, "recomputed", "stored", F.abs(F.col("recomputed") - F.col("stored")).alias("abs_diff"),
                    (F.abs(F.col("recomputed") - F.col("stored")) <= F.lit(tol)).alias("ok"))
