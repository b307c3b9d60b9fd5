"""Fact states that can be merged.

A state row holds what the transaction features need of a set of fact rows: counts, sums, first and last date,
the set of payment methods and the latest row.  States of disjoint sets of rows merge by one aggregation, so

* ``partial_states(txn, ["msno", "month"])`` is kept once for the whole fact, and the features at any cutoff are a
  merge of the whole months before it and of one edge month (``state_at``);
* ``advance`` adds later rows to a state per customer, so the next cutoff reads only what came after the last one.

A merge meets at most one row a month and customer, so a customer with a third of all fact rows is no larger
than any other, and states can lie in buckets of the customer (``sources.buckets``): a merge is then no shuffle.  Rows without a date belong to no cutoff and are left out, as the cutoff filter does; a missing
payment method is in no set; an empty fact gives no states.
"""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators.features import LATEST_COLUMNS

SUMS = {"total_cancellations": "is_cancel", "total_auto_renew": "is_auto_renew",
        "sum_payment_plan_days": "payment_plan_days", "total_revenue": "actual_amount_paid",
        "total_list_price": "plan_list_price"}


def with_month(txn: DataFrame) -> DataFrame:
    return txn.withColumn("month", F.floor(F.col("transaction_date") / 100).cast("int"))


def partial_states(txn: DataFrame, by: list[str], tie_break: str | None = "txn_id") -> DataFrame:
    """One state a group of fact rows: a partial and a final aggregate, one shuffle on ``by``."""
    date = F.col("transaction_date").cast("int").alias("transaction_date")
    at = F.struct(date, tie_break) if tie_break else F.struct(date)
    latest = F.struct(*[F.col(src).alias(dst) for src, dst in LATEST_COLUMNS])
    return txn.where(F.col("transaction_date").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        *[F.sum(src).cast("bigint").alias(dst) for dst, src in SUMS.items()],
        F.min(date).alias("first_transaction_date"),
        F.max(date).alias("last_transaction_date"),
        F.collect_set("payment_method_id").alias("payment_methods"),
        F.max(at).alias("latest_at"),
        F.max_by(latest, at).alias("latest"))


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of each group as one.  Sets are joined, and the latest row is that of the latest state."""
    return states.groupBy(*by).agg(
        F.sum("total_transactions").alias("total_transactions"),
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("first_transaction_date").alias("first_transaction_date"),
        F.max("last_transaction_date").alias("last_transaction_date"),
        F.array_distinct(F.flatten(F.collect_list("payment_methods"))).alias("payment_methods"),
        F.max("latest_at").alias("latest_at"),
        F.max_by("latest", "latest_at").alias("latest"))


def edge_month(cutoff: int) -> tuple[int, int] | None:
    """(first day, cutoff) of the month that the cutoff cuts, or None where it is a month's last day."""
    year, month, day = cutoff // 10000, cutoff // 100 % 100, cutoff % 100
    return None if day == calendar.monthrange(year, month)[1] else (cutoff // 100 * 100 + 1, cutoff)


def state_at(months: DataFrame, cutoff: int, edge_rows: DataFrame | None = None,
             tie_break: str | None = "txn_id") -> DataFrame:
    """The state of each customer at a cutoff.  ``edge_rows`` are fact rows that cover the edge month; without an
    edge month they are not read."""
    edge = edge_month(cutoff)
    if edge is None:
        return merge_states(months.where(F.col("month") <= cutoff // 100).drop("month"), ["msno"])
    if edge_rows is None:
        raise ValueError(f"cutoff {cutoff} cuts a month: its fact rows are needed")
    part = partial_states(edge_rows.where(F.col("transaction_date").between(*edge)), ["msno"], tie_break)
    whole = months.where(F.col("month") < cutoff // 100).drop("month")
    return merge_states(whole.unionByName(part), ["msno"])


def advance(state: DataFrame, later_rows: DataFrame, tie_break: str | None = "txn_id") -> DataFrame:
    """A state per customer with later fact rows added; ``later_rows`` must hold none that it has."""
    return merge_states(state.unionByName(partial_states(later_rows, ["msno"], tie_break)), ["msno"])


def aggregates(state: DataFrame) -> DataFrame:
    """A state per customer as the columns of ``features.transaction_aggregates``."""
    return state.select("*", F.size("payment_methods").cast("bigint").alias("num_distinct_payment_methods"),
                        "latest.*").drop("payment_methods", "latest_at", "latest")
