"""Registered queries over fact states that can be merged (A8, D1, D3, E1; C1, C2, C4 over them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.config import ROUNDS
from ebbflow.operators import states as ST
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import q
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.q_features import DS_DOUBLES
from ebbflow.plans.registry import register

MID_MONTH = 20001215  # a cutoff inside a month: its whole months are merged, its edge month is read


@register("monthly_states", q("""SELECT msno, CAST(transaction_date // 100 AS INTEGER) AS month,
  CAST(COUNT(*) AS BIGINT) AS total_transactions, CAST(SUM(actual_amount_paid) AS BIGINT) AS total_revenue,
  CAST(SUM(is_cancel) AS BIGINT) AS total_cancellations, MIN(transaction_date) AS first_transaction_date,
  MAX(transaction_date) AS last_transaction_date, CAST(COUNT(DISTINCT payment_method_id) AS BIGINT) AS n_payment_methods,
  CAST(arg_max(txn_id, transaction_date * 100000000000::HUGEINT + txn_id) AS BIGINT) AS latest_txn_id
FROM txn GROUP BY 1, 2"""))
def monthly_states(spark, sf):
    """The state of each customer and month of the whole fact, kept once."""
    return Chain.shared(spark, sf).monthly_states().select(
        "msno", "month", "total_transactions", "total_revenue", "total_cancellations", "first_transaction_date",
        "last_transaction_date", F.size("payment_methods").cast("bigint").alias("n_payment_methods"),
        F.col("latest_at.txn_id").alias("latest_txn_id"))


_TF = "SELECT *, '{r}' AS round FROM tf"


@register("features_from_states", sql_final(
    f"SELECT * FROM ({q(_TF.format(r='v1'), 'v1')}) a UNION ALL SELECT * FROM ({q(_TF.format(r='v2'), 'v2')}) b", DS_DOUBLES))
def features_from_states(spark, sf):
    """The transaction features of both rounds, merged from one stage of monthly states.  Both
    cutoffs end a month, so the fact is not read again."""
    parts = []
    for name in ("v1", "v2"):
        ch = Chain.shared(spark, sf, name)
        parts.append(ch.features_from_states(ch.state_at(ch.round.cutoff)).withColumn("round", F.lit(name)))
    return finalize(parts[0].unionByName(parts[1]))


@register("features_rolled_forward", sql_final(q("SELECT * FROM tf"), DS_DOUBLES))
def features_rolled_forward(spark, sf):
    """The features of v2 from the committed state at v1's cutoff and the fact rows after it."""
    ch, before = Chain.shared(spark, sf), ROUNDS["v1"]
    state = ST.advance(ch.snapshot(before.cutoff), ch.tables.transactions(before.window_start, ch.round.cutoff))
    return finalize(ch.features_from_states(state))


@register("mid_month_aggregates", q(f"""SELECT msno, CAST(COUNT(*) AS BIGINT) AS total_transactions,
  CAST(SUM(is_cancel) AS BIGINT) AS total_cancellations, CAST(SUM(is_auto_renew) AS BIGINT) AS total_auto_renew,
  CAST(SUM(payment_plan_days) AS BIGINT) AS sum_payment_plan_days, CAST(SUM(actual_amount_paid) AS BIGINT) AS total_revenue,
  CAST(SUM(plan_list_price) AS BIGINT) AS total_list_price, MIN(transaction_date) AS first_transaction_date,
  MAX(transaction_date) AS last_transaction_date, CAST(COUNT(DISTINCT payment_method_id) AS BIGINT) AS num_distinct_payment_methods,
  arg_max(payment_method_id, k) AS latest_payment_method_id, arg_max(payment_plan_days, k) AS latest_payment_plan_days,
  arg_max(plan_list_price, k) AS latest_plan_list_price, arg_max(actual_amount_paid, k) AS latest_actual_amount_paid,
  arg_max(is_auto_renew, k) AS latest_is_auto_renew, arg_max(is_cancel, k) AS latest_is_cancel,
  arg_max(membership_expire_date, k) AS latest_membership_expire_date
FROM (SELECT *, transaction_date * 100000000000::HUGEINT + txn_id AS k FROM txn WHERE transaction_date <= {MID_MONTH})
GROUP BY msno"""))
def mid_month_aggregates(spark, sf):
    """D1 / D3 / E1 at a cutoff inside a month: whole months from the stage, fifteen days from the fact."""
    return ST.aggregates(Chain.shared(spark, sf).state_at(MID_MONTH))


@register("modeling_dataset_from_states", sql_final(q("SELECT * FROM ds"), DS_DOUBLES))
def modeling_dataset_from_states(spark, sf):
    """C1, C2, C4 over merged states: the 40-column modeling table of round v2, without a shuffle once the
    bucketed stages are there."""
    return finalize(Chain.shared(spark, sf).dataset_from_states())
