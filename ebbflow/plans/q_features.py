"""Registered queries: scans, projections, feature table, quality checks (A, B1-B14, C1-C4, C13-C14, D1-D3, D36-D38, D41-D42, E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions import expr as X
from ebbflow.operators import features as FE
from ebbflow.operators import quality as QU
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.registry import register

TXN_COLS = ["msno", "txn_id", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid",
            "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel"]
DS_DOUBLES = ["cancel_rate", "auto_renew_pct", "avg_payment_plan_days", "avg_revenue_per_txn", "discount_rate"]


@register("transactions_scan", q("SELECT * FROM txn"))
def transactions_scan(spark, sf):
    """A1: typed fact scan (adapter over orders)."""
    return Chain.shared(spark, sf).transactions()


@register("members_scan", q("SELECT * FROM mem"))
def members_scan(spark, sf):
    """A2: typed dimension scan."""
    return Chain.shared(spark, sf).members()


_LAB = "SELECT msno, is_churn, '{r}' AS round FROM lab"


@register("labels_scan", f"SELECT * FROM ({q(_LAB.format(r='v1'), 'v1')}) a UNION ALL "
                         f"SELECT * FROM ({q(_LAB.format(r='v2'), 'v2')}) b")
def labels_scan(spark, sf):
    """A3: the behavioural labels of both rounds, one row per customer and round."""
    v1 = Chain.shared(spark, sf, "v1").labels().withColumn("round", F.lit("v1"))
    v2 = Chain.shared(spark, sf, "v2").labels().withColumn("round", F.lit("v2"))
    return v1.unionByName(v2)


@register("cutoff_filter", q("SELECT * FROM txn WHERE transaction_date <= 20010131"))
def cutoff_filter(spark, sf):
    """B1: leakage boundary; the bound on the raw order date reaches the scan."""
    ch = Chain.shared(spark, sf)
    return FE.cutoff_filter(ch.transactions_to_cutoff(), ch.round.cutoff)


@register("raw_scan_stats", q("SELECT CAST(COUNT(*) AS BIGINT) AS n_raw, MIN(transaction_date) AS raw_min_date, "
                              "MAX(transaction_date) AS raw_max_date, "
                              "CAST(COUNT(*) FILTER (WHERE transaction_date <= 20010131) AS BIGINT) AS n_used FROM txn"))
def raw_scan_stats(spark, sf):
    """Count, min, max and the rows inside the cutoff in one scan."""
    ch = Chain.shared(spark, sf)
    return FE.raw_scan_stats(ch.transactions(), ch.round.cutoff)


@register("transaction_features", sql_final(q("SELECT * FROM tf"), DS_DOUBLES))
def transaction_features(spark, sf):
    """D1 + D3 + E1 + B5-B9: per paying customer, one aggregation."""
    return finalize(Chain.shared(spark, sf).transaction_features())


@register("latest_transaction", q("SELECT msno, latest_payment_method_id, latest_payment_plan_days, latest_plan_list_price, "
                                  "latest_actual_amount_paid, latest_is_auto_renew, latest_is_cancel, "
                                  "latest_membership_expire_date FROM lt"))
def latest_transaction(spark, sf):
    """Most recent transaction per customer (ties broken by transaction id)."""
    ch = Chain.shared(spark, sf)
    a = FE.transaction_aggregates(ch.transactions_to_cutoff(), ch.round.cutoff)
    return a.select("msno", *[d for _, d in FE.LATEST_COLUMNS])


@register("agg_join_latest", q("SELECT agg.msno, agg.total_transactions, agg.total_revenue, lt.latest_is_auto_renew, "
                               "lt.latest_membership_expire_date FROM agg LEFT JOIN lt ON agg.msno = lt.msno"))
def agg_join_latest(spark, sf):
    """Aggregates beside the latest row.  Built as the single-aggregate form
    (no join); the SQL twin is the join form."""
    ch = Chain.shared(spark, sf)
    a = FE.transaction_aggregates(ch.transactions_to_cutoff(), ch.round.cutoff)
    return a.select("msno", "total_transactions", "total_revenue", "latest_is_auto_renew",
                    "latest_membership_expire_date")


@register("distinct_payment_methods", q("SELECT msno, num_distinct_payment_methods FROM agg"))
def distinct_payment_methods(spark, sf):
    """D3: exact distinct count of payment methods per customer."""
    ch = Chain.shared(spark, sf)
    return FE.transaction_aggregates(ch.transactions_to_cutoff(), ch.round.cutoff).select("msno", "num_distinct_payment_methods")


@register("member_features", q("SELECT * FROM mf"))
def member_features(spark, sf):
    """Cleaned demographics and tenure."""
    return Chain.shared(spark, sf).member_features()


@register("bd_clean", q("SELECT msno, bd, CASE WHEN bd BETWEEN 5 AND 100 THEN bd END AS bd_clean, "
                        "CASE WHEN bd < 5 OR bd > 100 THEN 1 ELSE 0 END AS bd_missing FROM mem"))
def bd_clean(spark, sf):
    """B2: invalid age -> NULL plus flag."""
    m = Chain.shared(spark, sf).members()
    f = FE.member_features(m, C.ROUND_V2.cutoff).select("msno", "bd_clean", "bd_missing")
    return m.select("msno", "bd").join(f, "msno")


@register("gender_missing", q("SELECT msno, gender, gender_missing FROM mf"))
def gender_missing(spark, sf):
    """Null flag."""
    return Chain.shared(spark, sf).member_features().select("msno", "gender", "gender_missing")


@register("registered_via_missing", q("SELECT msno, registered_via, registered_via_missing FROM mf"))
def registered_via_missing(spark, sf):
    """Sentinel flag (value kept)."""
    return Chain.shared(spark, sf).member_features().select("msno", "registered_via", "registered_via_missing")


@register("registration_parts", q("SELECT msno, registration_init_time, registration_year, registration_month FROM mf"))
def registration_parts(spark, sf):
    """Registration year and month."""
    return Chain.shared(spark, sf).member_features().select("msno", "registration_init_time", "registration_year",
                                                     "registration_month")


@register("expire_guard", q("SELECT msno, latest_membership_expire_date, membership_expire_date_invalid, "
                            "membership_remaining_days FROM tf"))
def expire_guard(spark, sf):
    """Sentinel expire date -> flag and NULL remaining days."""
    return Chain.shared(spark, sf).transaction_features().select(
        "msno", "latest_membership_expire_date", "membership_expire_date_invalid", "membership_remaining_days")


@register("safe_ratios", sql_final(q("SELECT msno, cancel_rate, auto_renew_pct, avg_payment_plan_days, "
                                     "avg_revenue_per_txn, discount_rate FROM tf"), DS_DOUBLES))
def safe_ratios(spark, sf):
    """Ratios, denominator 0 -> NULL."""
    return finalize(Chain.shared(spark, sf).transaction_features().select("msno", *DS_DOUBLES))


@register("total_discount", q("SELECT msno, total_list_price, total_revenue, total_discount FROM tf"))
def total_discount(spark, sf):
    """List minus paid (may be negative)."""
    return Chain.shared(spark, sf).transaction_features().select("msno", "total_list_price", "total_revenue",
                                                          "total_discount")


@register("day_diffs", q("SELECT msno, txn_span_days, days_since_last_txn, membership_remaining_days, "
                         "tenure_days_at_cutoff FROM ds"))
def day_diffs(spark, sf):
    """Day differences against the cutoff (tenure may be negative)."""
    return Chain.shared(spark, sf).dataset().select("msno", "txn_span_days", "days_since_last_txn",
                                             "membership_remaining_days", "tenure_days_at_cutoff")


@register("join_members_indicator", q("SELECT lab.msno, lab.is_churn, mf.city, "
                                      "CASE WHEN mf.msno IS NULL THEN 0 ELSE 1 END AS has_members_data "
                                      "FROM lab LEFT JOIN mf ON lab.msno = mf.msno"))
def join_members_indicator(spark, sf):
    """Labels left-joined to members with a presence flag."""
    ch = Chain.shared(spark, sf)
    return FE.join_with_indicator(ch.labels(), ch.member_features().select("msno", "city"), "has_members_data")


@register("join_txn_indicator", q("SELECT lab.msno, lab.is_churn, tf.total_revenue, "
                                  "CASE WHEN tf.msno IS NULL THEN 0 ELSE 1 END AS has_transactions_data "
                                  "FROM lab LEFT JOIN tf ON lab.msno = tf.msno"))
def join_txn_indicator(spark, sf):
    """Labels left-joined to transaction features with a presence flag."""
    ch = Chain.shared(spark, sf)
    return FE.join_with_indicator(ch.labels(), ch.transaction_features().select("msno", "total_revenue"),
                                  "has_transactions_data")


@register("zero_fill_counts", q("SELECT msno, total_transactions, total_cancellations, total_auto_renew, "
                                "num_distinct_payment_methods, total_revenue, has_transactions_data FROM ds"))
def zero_fill_counts(spark, sf):
    """Only the four counts become 0; revenue stays NULL."""
    return Chain.shared(spark, sf).dataset().select("msno", *C.ZERO_FILL_COUNTS, "total_revenue", "has_transactions_data")


@register("modeling_dataset", sql_final(q("SELECT * FROM ds"), DS_DOUBLES))
def modeling_dataset(spark, sf):
    """C4: the 40-column modeling table of round v2."""
    return finalize(Chain.shared(spark, sf).dataset())


@register("modeling_dataset_v1", sql_final(q("SELECT * FROM ds", "v1"), DS_DOUBLES))
def modeling_dataset_v1(spark, sf):
    """H2 input: the same feature code at the v1 cutoff (temporal training set)."""
    return finalize(Chain.shared(spark, sf, "v1").dataset())


def _cat_sql(c, numeric=True):
    return (f"COALESCE(printf('%.1f', CAST({c} AS DOUBLE)), 'nan') AS {c}" if numeric
            else f"COALESCE({c}, 'nan') AS {c}")


@register("categorical_as_string", q("SELECT msno, " + ", ".join(_cat_sql(c, c != "gender") for c in C.CAT_ONEHOT)
                                     + " FROM ds"))
def categorical_as_string(spark, sf):
    """Categorical columns as strings, missing is its own 'nan' category."""
    ds = Chain.shared(spark, sf).dataset()
    return ds.select("msno", *[X.as_category(c, numeric=(c != "gender")).alias(c) for c in C.CAT_ONEHOT])


@register("clip_columns", q("SELECT msno, "
                            "CASE WHEN bd_clean IS NULL THEN NULL ELSE greatest(5, least(80, bd_clean)) END AS bd_clip, "
                            "CASE WHEN total_transactions IS NULL THEN NULL ELSE greatest(0, least(50, total_transactions)) END AS txn_clip, "
                            "round(CASE WHEN avg_revenue_per_txn IS NULL THEN NULL ELSE greatest(0, least(600, avg_revenue_per_txn)) END, 6) AS rev_clip, "
                            "CASE WHEN latest_payment_plan_days IS NULL THEN NULL ELSE greatest(0, least(400, latest_payment_plan_days)) END AS plan_clip FROM ds"))
def clip_columns(spark, sf):
    """Clip to [lo, hi] keeping NULL."""
    ds = Chain.shared(spark, sf).dataset()
    return finalize(ds.select("msno",
                              X.clip_keep_null("bd_clean", 5, 80).cast("int").alias("bd_clip"),
                              X.clip_keep_null("total_transactions", 0, 50).cast("bigint").alias("txn_clip"),
                              X.clip_keep_null("avg_revenue_per_txn", 0.0, 600.0).alias("rev_clip"),
                              X.clip_keep_null("latest_payment_plan_days", 0, 400).cast("int").alias("plan_clip")))


# Bucket edges and labels of the exploratory churn-by-bucket views.
TENURE_EDGES, TENURE_LABELS = [-100000, 365, 730, 1095, 1825, 100000], ["<1yr", "1-2yr", "2-3yr", "3-5yr", "5yr+"]
TXN_EDGES, TXN_LABELS = [-1, 5, 10, 20, 1000], ["1-5", "6-10", "11-20", "21+"]
RECENCY_EDGES, RECENCY_LABELS = [-1, 30, 60, 90, 180, 365, 100000], ["0-30", "31-60", "61-90", "91-180", "181-365", "365+"]
REMAINING_EDGES = [-100000, -1, 30, 100000]
REMAINING_LABELS = ["expired\n(<0 days)", "0-30 days\nremaining", ">30 days\nremaining"]
BUCKETS = {
    "tenure_bucket": ("tenure_days_at_cutoff", TENURE_EDGES, TENURE_LABELS),
    "txn_bucket": ("total_transactions", TXN_EDGES, TXN_LABELS),
    "recency_bucket": ("days_since_last_txn", RECENCY_EDGES, RECENCY_LABELS),
    "remaining_bucket": ("membership_remaining_days", REMAINING_EDGES, REMAINING_LABELS),
}


def bucket_sql(col, edges, labels):
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {whens} END"


@register("feature_buckets", q("SELECT msno, " + ", ".join(f"{bucket_sql(c, e, lab)} AS {name}"
                                                          for name, (c, e, lab) in BUCKETS.items()) + " FROM ds"))
def feature_buckets(spark, sf):
    """Right-closed buckets of tenure, transactions, recency, remaining days."""
    ds = Chain.shared(spark, sf).dataset()
    return ds.select("msno", *[X.right_closed_bucket(c, e, lab).alias(name) for name, (c, e, lab) in BUCKETS.items()])


def _sanity_sql():
    rows = [("row_count_preserved", "n_rows", "CASE WHEN n_rows = n_labels THEN 'PASS' ELSE 'FAIL' END"),
            ("key_unique", "n_keys", "CASE WHEN n_rows = n_keys THEN 'PASS' ELSE 'FAIL' END"),
            ("churn_rate", "churn", "CASE WHEN churn > 0.05 AND churn < 0.15 THEN 'PASS' ELSE 'WARN' END"),
            ("max_last_transaction_date", "max_last", "CASE WHEN max_last IS NULL OR max_last <= 20010131 THEN 'PASS' ELSE 'FAIL' END"),
            ("coverage_members", "cm", "'INFO'"), ("coverage_transactions", "ct", "'INFO'"),
            ("membership_remaining_days_min", "mrd_min", "'INFO'"), ("membership_remaining_days_max", "mrd_max", "'INFO'"),
            ("membership_remaining_days_mean", "mrd_mean", "'INFO'"), ("tenure_days_at_cutoff_min", "ten_min", "'INFO'"),
            ("tenure_days_at_cutoff_max", "ten_max", "'INFO'"), ("tenure_days_at_cutoff_mean", "ten_mean", "'INFO'")]
    body = ("\n, d AS (SELECT COUNT(*) AS n_rows, COUNT(DISTINCT msno) AS n_keys, AVG(is_churn) AS churn, "
            "MAX(last_transaction_date) AS max_last, AVG(has_members_data) AS cm, AVG(has_transactions_data) AS ct, "
            "MIN(membership_remaining_days) AS mrd_min, MAX(membership_remaining_days) AS mrd_max, "
            "AVG(membership_remaining_days) AS mrd_mean, MIN(tenure_days_at_cutoff) AS ten_min, "
            "MAX(tenure_days_at_cutoff) AS ten_max, AVG(tenure_days_at_cutoff) AS ten_mean FROM ds), "
            "nl AS (SELECT COUNT(*) AS n_labels FROM lab)\n"
            + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", CAST({v} AS DOUBLE) AS value, {st} AS status FROM d, nl"
                                 for c, v, st in rows))
    return sql_final(q(body), ["value"])


@register("sanity_checks", _sanity_sql())
def sanity_checks(spark, sf):
    """One aggregate -> (check, value, status) rows; FAIL raises in jobs."""
    ch = Chain.shared(spark, sf)
    return finalize(QU.sanity_checks(ch.labels(), ch.dataset(), ch.round.cutoff))


@register("cleaning_counts", sql_final(q("""
SELECT CAST(COUNT(*) AS BIGINT) AS n_members,
       CAST(SUM(bd_missing) AS BIGINT) AS n_bd_invalid, SUM(bd_missing) * 100.0 / COUNT(*) AS pct_bd_invalid,
       CAST(SUM(registered_via_missing) AS BIGINT) AS n_via_unknown,
       SUM(registered_via_missing) * 100.0 / COUNT(*) AS pct_via_unknown,
       CAST(SUM(CASE WHEN tenure_days_at_cutoff < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_future_registration,
       CAST(SUM(gender_missing) AS BIGINT) AS n_gender_missing,
       (SELECT CAST(SUM(membership_expire_date_invalid) AS BIGINT) FROM tf) AS n_expire_invalid,
       (SELECT SUM(membership_expire_date_invalid) * 100.0 / COUNT(*) FROM tf) AS pct_expire_invalid
FROM mf"""), ["pct_bd_invalid", "pct_via_unknown", "pct_expire_invalid"]))
def cleaning_counts(spark, sf):
    """Invalid / unknown / future-registration counts and shares."""
    ch = Chain.shared(spark, sf)
    return finalize(QU.cleaning_counts(ch.member_features(), ch.transaction_features()))


def _round_stats_sql(r):
    return (f"SELECT '{r}' AS round, CAST(COUNT(*) AS BIGINT) AS n_rows, AVG(is_churn) AS churn_rate, "
            f"AVG(has_members_data) AS member_coverage, AVG(has_transactions_data) AS txn_coverage FROM ds")


@register("label_rate_shift", sql_final(f"SELECT * FROM ({q(_round_stats_sql('v1'), 'v1')}) a UNION ALL "
                                        f"SELECT * FROM ({q(_round_stats_sql('v2'), 'v2')}) b",
                                        ["churn_rate", "member_coverage", "txn_coverage"]))
def label_rate_shift(spark, sf):
    """Per round rows, churn rate and coverage, from the union of both rounds."""
    v1 = Chain.shared(spark, sf, "v1").dataset().withColumn("round", F.lit("v1"))
    v2 = Chain.shared(spark, sf, "v2").dataset().withColumn("round", F.lit("v2"))
    return finalize(QU.label_rate_shift(v1.unionByName(v2)))


@register("label_population_overlap",
          f"WITH a AS ({q('SELECT DISTINCT msno FROM lab', 'v1')}), b AS ({q('SELECT DISTINCT msno FROM lab', 'v2')}) "
          "SELECT CAST(COUNT(a.msno) AS BIGINT) AS n_v1, CAST(COUNT(b.msno) AS BIGINT) AS n_v2, "
          "CAST(COUNT(*) FILTER (WHERE a.msno IS NOT NULL AND b.msno IS NOT NULL) AS BIGINT) AS n_both, "
          "CAST(COUNT(*) FILTER (WHERE b.msno IS NULL) AS BIGINT) AS n_only_v1, "
          "CAST(COUNT(*) FILTER (WHERE a.msno IS NULL) AS BIGINT) AS n_only_v2 "
          "FROM a FULL OUTER JOIN b ON a.msno = b.msno")
def label_population_overlap(spark, sf):
    """Customers present in both rounds (inner join count, anti joins both ways)."""
    v1 = Chain.shared(spark, sf, "v1").labels()
    v2 = Chain.shared(spark, sf, "v2").labels()
    return QU.population_overlap(v1, v2)


@register("missing_blocks", q("""
SELECT has_members_data, has_transactions_data, CAST(COUNT(*) AS BIGINT) AS n_customers,
       MIN(m_nulls) AS min_member_nulls, MAX(m_nulls) AS max_member_nulls,
       MIN(t_nulls) AS min_txn_nulls, MAX(t_nulls) AS max_txn_nulls
FROM (SELECT has_members_data, has_transactions_data,
             CAST((city IS NULL)::INT + (gender_missing IS NULL)::INT + (registered_via IS NULL)::INT
                  + (registration_init_time IS NULL)::INT + (registration_year IS NULL)::INT
                  + (registration_month IS NULL)::INT + (tenure_days_at_cutoff IS NULL)::INT
                  + (bd_missing IS NULL)::INT + (registered_via_missing IS NULL)::INT AS INTEGER) AS m_nulls,
             CAST((total_revenue IS NULL)::INT + (total_list_price IS NULL)::INT + (first_transaction_date IS NULL)::INT
                  + (last_transaction_date IS NULL)::INT + (latest_payment_method_id IS NULL)::INT
                  + (latest_payment_plan_days IS NULL)::INT + (latest_plan_list_price IS NULL)::INT
                  + (latest_actual_amount_paid IS NULL)::INT + (latest_is_auto_renew IS NULL)::INT
                  + (latest_is_cancel IS NULL)::INT + (latest_membership_expire_date IS NULL)::INT
                  + (cancel_rate IS NULL)::INT + (auto_renew_pct IS NULL)::INT + (avg_payment_plan_days IS NULL)::INT
                  + (avg_revenue_per_txn IS NULL)::INT + (total_discount IS NULL)::INT
                  + (membership_expire_date_invalid IS NULL)::INT + (txn_span_days IS NULL)::INT
                  + (days_since_last_txn IS NULL)::INT AS INTEGER) AS t_nulls
      FROM ds)
GROUP BY has_members_data, has_transactions_data"""))
def missing_blocks(spark, sf):
    """Member columns are missing together iff has_members_data = 0, and
    transaction columns iff has_transactions_data = 0."""
    return QU.missing_blocks(Chain.shared(spark, sf).dataset())


@register("exact_redundancies", q("""
SELECT 'total_discount = list - revenue' AS identity, CAST(COUNT(*) FILTER (WHERE total_discount <> total_list_price - total_revenue) AS BIGINT) AS n_violations, CAST(COUNT(*) FILTER (WHERE total_discount IS NOT NULL) AS BIGINT) AS n_checked FROM ds
UNION ALL SELECT 'txn_span = last - first', CAST(COUNT(*) FILTER (WHERE txn_span_days <> date_diff('day', strptime(CAST(first_transaction_date AS VARCHAR), '%Y%m%d'), strptime(CAST(last_transaction_date AS VARCHAR), '%Y%m%d'))) AS BIGINT), CAST(COUNT(*) FILTER (WHERE txn_span_days IS NOT NULL) AS BIGINT) FROM ds
UNION ALL SELECT 'avg_revenue_per_txn = revenue / transactions', CAST(COUNT(*) FILTER (WHERE abs(avg_revenue_per_txn * total_transactions - total_revenue) > 1e-6 * greatest(1, abs(total_revenue))) AS BIGINT), CAST(COUNT(*) FILTER (WHERE avg_revenue_per_txn IS NOT NULL) AS BIGINT) FROM ds
UNION ALL SELECT 'cancel_rate = cancellations / transactions', CAST(COUNT(*) FILTER (WHERE abs(cancel_rate * total_transactions - total_cancellations) > 1e-6) AS BIGINT), CAST(COUNT(*) FILTER (WHERE cancel_rate IS NOT NULL) AS BIGINT) FROM ds
UNION ALL SELECT 'auto_renew_pct = auto_renew / transactions', CAST(COUNT(*) FILTER (WHERE abs(auto_renew_pct * total_transactions - total_auto_renew) > 1e-6) AS BIGINT), CAST(COUNT(*) FILTER (WHERE auto_renew_pct IS NOT NULL) AS BIGINT) FROM ds"""))
def exact_redundancies(spark, sf):
    """Published identities checked row by row, long table."""
    return QU.exact_redundancies(Chain.shared(spark, sf).dataset())
