"""Constants that carry semantics.  The cutoff is always an argument; the values
here are defaults and the fixed rule parameters of the analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Round:
    """One prediction round: features see ``transaction_date <= cutoff``; the
    behavioural label looks at ``[window_start, window_end]``."""

    name: str
    cutoff: int
    window_start: int
    window_end: int
    expire_floor: int = 20100101  # latest expire date below this is a garbage sentinel


# Rounds used with the driver's test tables (order dates 1995-01-01 .. 2001-08-01).
# The test tables start in 1995, so their sentinel floor is 1990-01-01 (the
# 19700101 placeholder stays below it, real expiry dates stay above it).
ROUND_V1 = Round("v1", 20000731, 20000801, 20010131, 19900101)
ROUND_V2 = Round("v2", 20010131, 20010201, 20010731, 19900101)
ROUNDS = {"v1": ROUND_V1, "v2": ROUND_V2}

# Fixed values of the analysis (must equal the original pipeline's rules).
BD_MIN_VALID = 5
BD_MAX_VALID = 100
REGISTERED_VIA_UNKNOWN = -1
EXPIRE_DATE_MIN_VALID = 20100101  # real data; the test rounds carry their own floor
THRESHOLD_GRID = [round(0.05 * k, 2) for k in range(1, 20)]  # 0.05 .. 0.95
PRECISION_TARGET_HIGH = 0.55
HIGH_REPAIR_STEP = 0.10
SEGMENT_TENURE_VETERAN = 730
SEGMENT_TENURE_NEWCOMER = 180
SEGMENT_DISCOUNT_RATE = 0.05
SEGMENT_CHAMPION_TXNS = 20
RECENCY_FLAG_DAYS = 30
CANCEL_FLAG_RATE = 0.05
DEVIATION_FACTOR = 1.5
SEARCH_CAP = 200
QUEUE_CAP = 500
MONTH_DAYS = 30.44
CURRENCY_RATE = 2.62
ERROR_ANALYSIS_THRESHOLD = 0.65
SEED = 42


# Feature roles (fixed lists of the original modeling dataset).
CAT_ONEHOT = ["city", "gender", "registered_via", "latest_payment_method_id",
              "registration_month", "num_distinct_payment_methods"]
BINARY_FLAGS = ["bd_missing", "gender_missing", "registered_via_missing", "has_members_data",
                "has_transactions_data", "latest_is_auto_renew", "latest_is_cancel",
                "membership_expire_date_invalid"]
NUMERIC_CONTINUOUS = ["bd_clean", "registration_init_time", "registration_year",
                      "tenure_days_at_cutoff", "total_transactions", "total_cancellations",
                      "total_auto_renew", "total_revenue", "total_list_price",
                      "first_transaction_date", "last_transaction_date",
                      "latest_payment_plan_days", "latest_plan_list_price",
                      "latest_actual_amount_paid", "latest_membership_expire_date",
                      "cancel_rate", "auto_renew_pct", "avg_payment_plan_days",
                      "avg_revenue_per_txn", "total_discount", "discount_rate",
                      "txn_span_days", "days_since_last_txn", "membership_remaining_days"]
ALL_FEATURES = CAT_ONEHOT + BINARY_FLAGS + NUMERIC_CONTINUOUS
PROXY_EXCLUDE = ["membership_remaining_days", "days_since_last_txn", "latest_is_cancel",
                 "last_transaction_date", "latest_membership_expire_date",
                 "membership_expire_date_invalid"]
ZERO_FILL_COUNTS = ["total_transactions", "total_cancellations", "total_auto_renew",
                    "num_distinct_payment_methods"]

# Behaviour columns profiled per tier / segment (fixed list).
CHAR_COLS = ["tenure_days_at_cutoff", "latest_is_auto_renew", "auto_renew_pct",
             "total_transactions", "avg_revenue_per_txn", "discount_rate",
             "cancel_rate", "days_since_last_txn"]

TIER_ORDER = ["Low", "Medium", "High"]
ELEVATED_TIERS = ["High", "Medium"]
VALUE_UNKNOWN = "Unknown (no transaction data)"
STABLE_MONITOR = "Stable / Monitor"
UNMATCHED_AT_RISK = "Unmatched At-Risk (no segment)"
CHAMPIONS = "Engaged Low-Risk (Champions)"
SEGMENT_ORDER = ["At-Risk, Auto-Renew Off", "At-Risk Veteran", "At-Risk Newcomer",
                 "At-Risk, Price-Sensitive", CHAMPIONS, STABLE_MONITOR]
GROUP_ORDER = ["At-Risk, Auto-Renew Off", "At-Risk Veteran", "At-Risk Newcomer",
               "At-Risk, Price-Sensitive", UNMATCHED_AT_RISK, CHAMPIONS, STABLE_MONITOR]
NON_RETENTION_GROUPS = [CHAMPIONS, STABLE_MONITOR]
