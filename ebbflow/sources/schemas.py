"""Explicit schemas of the raw inputs (no sniffing of a 21M-row file)."""

from pyspark.sql.types import (ByteType, IntegerType, ShortType, StringType, StructField,
                               StructType)

TRANSACTIONS = StructType([
    StructField("msno", StringType()),
    StructField("payment_method_id", ShortType()),
    StructField("payment_plan_days", ShortType()),
    StructField("plan_list_price", IntegerType()),
    StructField("actual_amount_paid", IntegerType()),
    StructField("is_auto_renew", ByteType()),
    StructField("transaction_date", IntegerType()),
    StructField("membership_expire_date", IntegerType()),
    StructField("is_cancel", ByteType()),
])

MEMBERS = StructType([
    StructField("msno", StringType()),
    StructField("city", ByteType()),
    StructField("bd", IntegerType()),
    StructField("gender", StringType()),
    StructField("registered_via", ByteType()),
    StructField("registration_init_time", IntegerType()),
])

LABELS = StructType([
    StructField("msno", StringType()),
    StructField("is_churn", ByteType()),
])
