"""Feature table edge rules on hand-written frames."""

from pyspark.sql import Row

from ebbflow.operators import features as FE

TXN_SCHEMA = ("msno string, txn_id long, payment_method_id int, payment_plan_days int, plan_list_price int, "
              "actual_amount_paid int, is_auto_renew int, transaction_date int, membership_expire_date int, is_cancel int")


def test_latest_row_ties_broken_by_txn_id_and_cutoff_respected(spark):
    rows = [("a", 1, 10, 30, 100, 100, 1, 20170101, 20170131, 0),
            ("a", 2, 11, 30, 100, 90, 0, 20170201, 20170303, 0),
            ("a", 3, 12, 30, 0, 0, 1, 20170201, 19700101, 1),   # same day, higher id -> latest
            ("a", 4, 13, 30, 100, 100, 1, 20170301, 20170331, 0),  # after cutoff: ignored
            ("b", 5, 10, 30, 0, 0, 1, 20170110, 20170209, 0)]
    t = spark.createDataFrame(rows, TXN_SCHEMA)
    f = {r["msno"]: r for r in FE.transaction_features(t, 20170228).collect()}
    a = f["a"]
    assert a["total_transactions"] == 3 and a["num_distinct_payment_methods"] == 3
    assert a["latest_payment_method_id"] == 12 and a["latest_is_cancel"] == 1
    assert a["membership_expire_date_invalid"] == 1 and a["membership_remaining_days"] is None
    assert a["days_since_last_txn"] == 27 and a["txn_span_days"] == 31
    assert a["total_discount"] == 10 and abs(a["discount_rate"] - 10 / 200) < 1e-12
    b = f["b"]
    assert b["discount_rate"] is None  # list price 0 -> NULL, not 0 or an error
    assert b["membership_remaining_days"] == -19


def test_member_features_flags_and_negative_tenure(spark):
    m = spark.createDataFrame([("a", 1, 3, None, -1, 20170301), ("b", 2, 30, "male", 7, 20150101),
                               ("c", 3, None, "female", None, 20160229)],
                              "msno string, city int, bd int, gender string, registered_via int, registration_init_time int")
    f = {r["msno"]: r for r in FE.member_features(m, 20170228).collect()}
    assert f["a"]["bd_clean"] is None and f["a"]["bd_missing"] == 1 and f["a"]["gender_missing"] == 1
    assert f["a"]["registered_via_missing"] == 1 and f["a"]["tenure_days_at_cutoff"] == -1
    assert f["b"]["bd_clean"] == 30 and f["b"]["bd_missing"] == 0 and f["b"]["registration_year"] == 2015
    assert f["c"]["bd_missing"] == 0 and f["c"]["registered_via_missing"] == 0


def test_customer_without_transactions_counts_zero_ratios_null(spark):
    labels = spark.createDataFrame([Row(msno="a", is_churn=1), Row(msno="z", is_churn=0)])
    members = spark.createDataFrame([("a", 1, 30, None, 3, 20150101)],
                                    "msno string, city int, bd int, gender string, registered_via int, registration_init_time int")
    t = spark.createDataFrame([("a", 1, 10, 30, 100, 100, 1, 20170101, 20170131, 0)], TXN_SCHEMA)
    ds = {r["msno"]: r for r in FE.modeling_dataset(labels, members, t, 20170228).collect()}
    z = ds["z"]
    assert z["total_transactions"] == 0 and z["num_distinct_payment_methods"] == 0
    assert z["cancel_rate"] is None and z["total_revenue"] is None and z["days_since_last_txn"] is None
    assert z["has_transactions_data"] == 0 and z["has_members_data"] == 0
    assert ds["a"]["has_transactions_data"] == 1 and ds["a"]["has_members_data"] == 1
    assert len(FE.MODELING_COLUMNS) == 40
