"""Adapters that present the driver's Parquet tables in the shape of the raw
subscription tables (transactions, members, labels).

Fixed values of the mapping (so that the SQL twin in ``plans/oracle.py`` computes
the same rows):
  key:                    msno = 'C+' || o_custkey || '/='   (keeps '+' and '/')
  payment_method_id:      (o_orderkey*7 + o_custkey) % 40
  payment_plan_days:      first char of o_orderpriority 1->30, 2->30, 3->90, 4->180, else 410
  plan_list_price:        0 when o_orderkey % 61 = 0 else floor(o_totalprice/1000)
  actual_amount_paid:     floor(o_totalprice/1000) - (floor(o_totalprice/20000) when o_orderkey % 4 = 0)
  is_auto_renew:          0 when o_orderstatus = 'F' else 1
  transaction_date:       o_orderdate as yyyymmdd
  membership_expire_date: 19700101 when o_orderkey % 97 = 0 else order date + plan days
  is_cancel:              1 when o_orderkey % 50 = 0
  members:                customers with c_custkey % 9 <> 0
  city:                   c_nationkey + 1
  bd:                     floor(c_acctbal/100)
  gender:                 c_custkey % 5: 0 male, 1 female, else NULL
  registered_via:         -1 when c_custkey % 97 = 0; AUTOMOBILE 3, BUILDING 4, FURNITURE 7,
                          HOUSEHOLD 9, other 13
  registration_init_time: 1995-01-01 + (c_custkey*37 % 2500) days
  labels:                 every customer; label A = no transaction inside the outcome window
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.config import ROUNDS, Round
from ebbflow.functions.expr import date_to_yyyymmdd


def msno_of(custkey) -> F.Column:
    return F.concat(F.lit("C+"), F.col(custkey).cast("string"), F.lit("/="))


@dataclass
class TestTables:
    """Reads ``{sf_dir}/{table}.parquet`` and exposes the subscription tables."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def transactions(self, date_from: int | None = None, date_to: int | None = None) -> DataFrame:
        """Adapted fact table.  Optional inclusive yyyymmdd bounds are applied to the
        raw ``o_orderdate`` column so they reach the Parquet reader as pushed
        filters (the derived ``transaction_date`` is not pushable)."""
        o = self.raw("orders")
        if date_from is not None:
            o = o.where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit(str(date_from)), F.lit("yyyyMMdd")))
        if date_to is not None:
            o = o.where(F.col("o_orderdate") < F.date_add(F.to_date(F.lit(str(date_to)), "yyyyMMdd"), 1)
                        .cast("timestamp_ntz"))
        plan_days = (
            F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.lit(30))
            .when(F.substring("o_orderpriority", 1, 1) == "3", F.lit(90))
            .when(F.substring("o_orderpriority", 1, 1) == "4", F.lit(180))
            .otherwise(F.lit(410))
        )
        price_k = F.floor(F.col("o_totalprice") / 1000)
        odate = F.to_date("o_orderdate")
        return o.select(
            msno_of("o_custkey").alias("msno"),
            F.col("o_orderkey").alias("txn_id"),
            ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 40).cast("int").alias("payment_method_id"),
            plan_days.cast("int").alias("payment_plan_days"),
            F.when(F.col("o_orderkey") % 61 == 0, F.lit(0)).otherwise(price_k).cast("int").alias("plan_list_price"),
            (price_k - F.when(F.col("o_orderkey") % 4 == 0, F.floor(F.col("o_totalprice") / 20000)).otherwise(0))
            .cast("int").alias("actual_amount_paid"),
            F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("int").alias("is_auto_renew"),
            date_to_yyyymmdd(odate).alias("transaction_date"),
            F.when(F.col("o_orderkey") % 97 == 0, F.lit(19700101))
            .otherwise(date_to_yyyymmdd(F.date_add(odate, plan_days))).cast("int").alias("membership_expire_date"),
            F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0).cast("int").alias("is_cancel"),
        )

    def members(self) -> DataFrame:
        c = self.raw("customer")
        via = (
            F.when(F.col("c_custkey") % 97 == 0, F.lit(-1))
            .when(F.col("c_mktsegment") == "AUTOMOBILE", 3)
            .when(F.col("c_mktsegment") == "BUILDING", 4)
            .when(F.col("c_mktsegment") == "FURNITURE", 7)
            .when(F.col("c_mktsegment") == "HOUSEHOLD", 9)
            .otherwise(13)
        )
        reg = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 37 % 2500).cast("int"))
        return c.where(F.col("c_custkey") % 9 != 0).select(
            msno_of("c_custkey").alias("msno"),
            (F.col("c_nationkey") + 1).cast("int").alias("city"),
            F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"),
            F.when(F.col("c_custkey") % 5 == 0, "male").when(F.col("c_custkey") % 5 == 1, "female").alias("gender"),
            via.cast("int").alias("registered_via"),
            date_to_yyyymmdd(reg).alias("registration_init_time"),
        )

    def customer_keys(self) -> DataFrame:
        return self.raw("customer").select(msno_of("c_custkey").alias("msno"))

    def labels(self, round_: str | Round = "v2") -> DataFrame:
        """Label A (behavioural): 1 when the customer has no transaction inside the
        round's outcome window.  A semi-join style left join of distinct active
        keys, so each side is shuffled once on msno."""
        r = ROUNDS[round_] if isinstance(round_, str) else round_
        active = (
            self.transactions(r.window_start, r.window_end)
            .where(F.col("transaction_date").between(r.window_start, r.window_end))
            .select("msno").distinct().withColumn("_active", F.lit(1))
        )
        return (
            self.customer_keys().join(active, "msno", "left")
            .select("msno", F.when(F.col("_active").isNull(), 1).otherwise(0).cast("int").alias("is_churn"))
        )

    def conversations(self) -> DataFrame:
        return self.raw("conversations")
