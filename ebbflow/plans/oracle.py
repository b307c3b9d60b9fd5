"""DuckDB SQL twins of the registered queries (the correctness oracle).

The twin is written independently of the Spark code path: brute-force where the
Spark side is clever (the sweep is a cross join of grid x customers, the latest
row is a ROW_NUMBER filter, modes are COUNT + ROW_NUMBER), so agreement means
something.  ``chain(round)`` returns a WITH-prefix defining, in order:

  txn    adapted transactions            mem   adapted members
  lab    behavioural labels              tf    transaction features
  mf     member features                 ds    modeling dataset (40 columns)
  sc     scorecard + label B             sweep threshold sweep (19 rows)
  th     selected thresholds (1 row)     pred  ds + scores + risk_tier
  seg    pred + segment                  edges tercile edges (1 row)
  vt     seg + value_tier                act   vt + recommendation, intensity, priority_group
"""

from __future__ import annotations

from ebbflow import config as C
from ebbflow.config import ROUNDS
from ebbflow.functions.expr import INTENSITY


def _date(yyyymmdd: str) -> str:
    return f"CAST(strptime(CAST({yyyymmdd} AS VARCHAR), '%Y%m%d') AS DATE)"


def _lit_date(v: int) -> str:
    s = str(v)
    return f"DATE '{s[:4]}-{s[4:6]}-{s[6:]}'"


def _yyyymmdd(d: str) -> str:
    return f"CAST(strftime({d}, '%Y%m%d') AS INTEGER)"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def hash_u(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def segment_case(tier: str = "risk_tier") -> str:
    at = f"{tier} IN ('High', 'Medium')"
    s = C.SEGMENT_ORDER
    return (f"CASE WHEN {at} AND latest_is_auto_renew = 0 THEN {_str(s[0])} "
            f"WHEN {at} AND tenure_days_at_cutoff >= 730 THEN {_str(s[1])} "
            f"WHEN {at} AND tenure_days_at_cutoff < 180 THEN {_str(s[2])} "
            f"WHEN {at} AND discount_rate > 0.05 THEN {_str(s[3])} "
            f"WHEN {tier} = 'Low' AND total_transactions >= 20 AND latest_is_auto_renew = 1 THEN {_str(s[4])} "
            f"ELSE {_str(s[5])} END")


def recommend_case(r: str = "risk_tier", v: str = "value_tier") -> str:
    from ebbflow.functions import expr as E
    return (f"CASE WHEN {v} = {_str(C.VALUE_UNKNOWN)} THEN {_str(E.REC_INSUFFICIENT)} "
            f"WHEN {r} = 'High' AND {v} IN ('High', 'Medium') THEN {_str(E.REC_HIGH_TOUCH)} "
            f"WHEN {r} = 'High' AND {v} = 'Low' THEN {_str(E.REC_LOW_COST_CAPPED)} "
            f"WHEN {r} = 'Medium' AND {v} = 'High' THEN {_str(E.REC_MODERATE)} "
            f"WHEN {r} = 'Medium' THEN {_str(E.REC_LOW_COST_AUTO)} "
            f"WHEN {r} = 'Low' AND {v} = 'High' THEN {_str(E.REC_ADVOCACY)} "
            f"ELSE {_str(E.REC_MONITOR)} END")


def intensity_case(rec: str) -> str:
    whens = " ".join(f"WHEN {rec} = {_str(k)} THEN {_str(v)}" for k, v in INTENSITY.items())
    return f"CASE {whens} END"


def points_sql(proxy: bool = False) -> str:
    terms = ["(CASE WHEN latest_is_auto_renew = 0 THEN 35 ELSE 0 END)",
             "(CASE WHEN tenure_days_at_cutoff < 180 THEN 10 ELSE 0 END)",
             "(CASE WHEN cancel_rate > 0.05 THEN 10 ELSE 0 END)",
             "greatest(0, 15 - total_transactions)"]
    if not proxy:
        terms += ["(CASE WHEN days_since_last_txn > 365 THEN 40 WHEN days_since_last_txn > 180 THEN 25 "
                  "WHEN days_since_last_txn > 90 THEN 10 ELSE 0 END)",
                  "(CASE WHEN latest_is_cancel = 1 THEN 15 ELSE 0 END)"]
    return f"CAST(CASE WHEN has_transactions_data = 0 THEN 50 ELSE least(100, {' + '.join(terms)}) END AS INTEGER)"


GRID_VALUES = ", ".join(f"({i + 1}, CAST({t:.2f} AS DOUBLE))" for i, t in enumerate(C.THRESHOLD_GRID))


def chain(round_: str = "v2") -> str:
    r = ROUNDS[round_]
    cut = _lit_date(r.cutoff)
    msno_o = "concat('C+', CAST(o_custkey AS VARCHAR), '/=')"
    msno_c = "concat('C+', CAST(c_custkey AS VARCHAR), '/=')"
    latest = [("payment_method_id", "latest_payment_method_id"), ("payment_plan_days", "latest_payment_plan_days"),
              ("plan_list_price", "latest_plan_list_price"), ("actual_amount_paid", "latest_actual_amount_paid"),
              ("is_auto_renew", "latest_is_auto_renew"), ("is_cancel", "latest_is_cancel"),
              ("membership_expire_date", "latest_membership_expire_date")]
    return f"""WITH RECURSIVE
o1 AS (
  SELECT *, CAST(CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 30
                      WHEN substr(o_orderpriority, 1, 1) = '3' THEN 90
                      WHEN substr(o_orderpriority, 1, 1) = '4' THEN 180 ELSE 410 END AS INTEGER) AS plan_days
  FROM orders),
txn AS (
  SELECT {msno_o} AS msno, o_orderkey AS txn_id,
         CAST((o_orderkey * 7 + o_custkey) % 40 AS INTEGER) AS payment_method_id,
         plan_days AS payment_plan_days,
         CAST(CASE WHEN o_orderkey % 61 = 0 THEN 0 ELSE floor(o_totalprice / 1000) END AS INTEGER) AS plan_list_price,
         CAST(floor(o_totalprice / 1000) - CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice / 20000) ELSE 0 END
              AS INTEGER) AS actual_amount_paid,
         CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS is_auto_renew,
         {_yyyymmdd('o_orderdate')} AS transaction_date,
         CASE WHEN o_orderkey % 97 = 0 THEN 19700101
              ELSE {_yyyymmdd('CAST(o_orderdate AS DATE) + plan_days')} END AS membership_expire_date,
         CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS is_cancel
  FROM o1),
mem AS (
  SELECT {msno_c} AS msno, CAST(c_nationkey + 1 AS INTEGER) AS city,
         CAST(floor(c_acctbal / 100) AS INTEGER) AS bd,
         CASE WHEN c_custkey % 5 = 0 THEN 'male' WHEN c_custkey % 5 = 1 THEN 'female' END AS gender,
         CASE WHEN c_custkey % 97 = 0 THEN -1 WHEN c_mktsegment = 'AUTOMOBILE' THEN 3
              WHEN c_mktsegment = 'BUILDING' THEN 4 WHEN c_mktsegment = 'FURNITURE' THEN 7
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 9 ELSE 13 END AS registered_via,
         {_yyyymmdd("DATE '1995-01-01' + CAST(c_custkey * 37 % 2500 AS INTEGER)")} AS registration_init_time
  FROM customer WHERE c_custkey % 9 <> 0),
lab AS (
  SELECT {msno_c} AS msno, CASE WHEN a.msno IS NULL THEN 1 ELSE 0 END AS is_churn
  FROM customer LEFT JOIN (SELECT DISTINCT msno FROM txn
                           WHERE transaction_date BETWEEN {r.window_start} AND {r.window_end}) a
       ON a.msno = {msno_c}),
ft AS (SELECT * FROM txn WHERE transaction_date <= {r.cutoff}),
agg AS (
  SELECT msno, CAST(COUNT(*) AS BIGINT) AS total_transactions,
         CAST(SUM(is_cancel) AS BIGINT) AS total_cancellations,
         CAST(SUM(is_auto_renew) AS BIGINT) AS total_auto_renew,
         CAST(SUM(payment_plan_days) AS BIGINT) AS sum_payment_plan_days,
         CAST(SUM(actual_amount_paid) AS BIGINT) AS total_revenue,
         CAST(SUM(plan_list_price) AS BIGINT) AS total_list_price,
         CAST(MIN(transaction_date) AS INTEGER) AS first_transaction_date,
         CAST(MAX(transaction_date) AS INTEGER) AS last_transaction_date,
         CAST(COUNT(DISTINCT payment_method_id) AS BIGINT) AS num_distinct_payment_methods
  FROM ft GROUP BY msno),
lt AS (
  SELECT msno, {", ".join(f"{a} AS {b}" for a, b in latest)}
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY msno ORDER BY transaction_date DESC, txn_id DESC) AS rn FROM ft)
  WHERE rn = 1),
tf AS (
  SELECT agg.msno, total_transactions, total_cancellations, total_auto_renew, total_revenue, total_list_price,
         first_transaction_date, last_transaction_date, num_distinct_payment_methods,
         {", ".join(b for _, b in latest)},
         {_div('total_cancellations', 'total_transactions')} AS cancel_rate,
         {_div('total_auto_renew', 'total_transactions')} AS auto_renew_pct,
         {_div('sum_payment_plan_days', 'total_transactions')} AS avg_payment_plan_days,
         {_div('total_revenue', 'total_transactions')} AS avg_revenue_per_txn,
         total_list_price - total_revenue AS total_discount,
         {_div('total_list_price - total_revenue', 'total_list_price')} AS discount_rate,
         CASE WHEN latest_membership_expire_date < {r.expire_floor} THEN 1 ELSE 0 END AS membership_expire_date_invalid,
         CAST(date_diff('day', {_date('first_transaction_date')}, {_date('last_transaction_date')}) AS INTEGER)
              AS txn_span_days,
         CAST(date_diff('day', {_date('last_transaction_date')}, {cut}) AS INTEGER) AS days_since_last_txn,
         CAST(CASE WHEN latest_membership_expire_date >= {r.expire_floor}
                   THEN date_diff('day', {cut}, {_date('latest_membership_expire_date')}) END AS INTEGER)
              AS membership_remaining_days
  FROM agg JOIN lt ON agg.msno = lt.msno),
mf AS (
  SELECT msno, city, CASE WHEN bd BETWEEN 5 AND 100 THEN bd END AS bd_clean,
         CASE WHEN bd < 5 OR bd > 100 THEN 1 ELSE 0 END AS bd_missing, gender,
         CASE WHEN gender IS NULL THEN 1 ELSE 0 END AS gender_missing, registered_via,
         CASE WHEN registered_via = -1 THEN 1 ELSE 0 END AS registered_via_missing, registration_init_time,
         CAST(year(reg) AS INTEGER) AS registration_year, CAST(month(reg) AS INTEGER) AS registration_month,
         CAST(date_diff('day', reg, {cut}) AS INTEGER) AS tenure_days_at_cutoff
  FROM (SELECT *, {_date('registration_init_time')} AS reg FROM mem)),
ds AS (
  SELECT lab.msno, lab.is_churn,
         mf.city, mf.bd_clean, mf.bd_missing, mf.gender, mf.gender_missing, mf.registered_via,
         mf.registered_via_missing, mf.registration_init_time, mf.registration_year, mf.registration_month,
         mf.tenure_days_at_cutoff, CASE WHEN mf.msno IS NULL THEN 0 ELSE 1 END AS has_members_data,
         COALESCE(tf.total_transactions, 0) AS total_transactions,
         COALESCE(tf.total_cancellations, 0) AS total_cancellations,
         COALESCE(tf.total_auto_renew, 0) AS total_auto_renew,
         tf.total_revenue, tf.total_list_price, tf.first_transaction_date, tf.last_transaction_date,
         COALESCE(tf.num_distinct_payment_methods, 0) AS num_distinct_payment_methods,
         tf.latest_payment_method_id, tf.latest_payment_plan_days, tf.latest_plan_list_price,
         tf.latest_actual_amount_paid, tf.latest_is_auto_renew, tf.latest_is_cancel,
         tf.latest_membership_expire_date, tf.cancel_rate, tf.auto_renew_pct, tf.avg_payment_plan_days,
         tf.avg_revenue_per_txn, tf.total_discount, tf.discount_rate, tf.membership_expire_date_invalid,
         tf.txn_span_days, tf.days_since_last_txn, tf.membership_remaining_days,
         CASE WHEN tf.msno IS NULL THEN 0 ELSE 1 END AS has_transactions_data
  FROM lab LEFT JOIN mf ON lab.msno = mf.msno LEFT JOIN tf ON lab.msno = tf.msno),
sc0 AS (
  SELECT ds.* EXCLUDE (is_churn), is_churn AS is_churn_behavioural,
         {points_sql(False)} AS points, {points_sql(True)} AS points_proxy
  FROM ds),
sc AS (
  SELECT *, points / 100.0 AS risk_score_full, points_proxy / 100.0 AS risk_score_proxy_controlled,
         CASE WHEN {hash_u("msno || '|y'")} < points / 110.0 THEN 1 ELSE 0 END AS is_churn
  FROM sc0),
grid AS (SELECT * FROM (VALUES {GRID_VALUES}) g(bucket, threshold)),
sweep0 AS (
  SELECT g.threshold,
         SUM(CASE WHEN s.risk_score_full >= g.threshold THEN 1 ELSE 0 END) AS n_t,
         SUM(CASE WHEN s.risk_score_full >= g.threshold AND s.is_churn = 1 THEN 1 ELSE 0 END) AS tp,
         COUNT(*) AS n_all, SUM(s.is_churn) AS p_all
  FROM grid g CROSS JOIN sc s GROUP BY g.threshold),
sweep AS (
  SELECT threshold,
         CASE WHEN n_t > 0 THEN tp / n_t ELSE 0.0 END AS precision,
         CASE WHEN p_all > 0 THEN tp / p_all ELSE 0.0 END AS recall,
         CASE WHEN n_t + p_all > 0 THEN 2.0 * tp / (n_t + p_all) ELSE 0.0 END AS f1,
         n_t / n_all * 100.0 AS pct_targeted, CAST(n_t AS BIGINT) AS n_targeted
  FROM sweep0),
th0 AS (
  SELECT COALESCE((SELECT MIN(threshold) FROM sweep WHERE precision >= {C.PRECISION_TARGET_HIGH}),
                  (SELECT threshold FROM sweep ORDER BY precision DESC, threshold ASC LIMIT 1)) AS high0,
         (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1) AS medium,
         (SELECT MAX(threshold) FROM sweep) AS top),
th AS (
  SELECT CASE WHEN high0 <= medium THEN least(top, round(medium + {C.HIGH_REPAIR_STEP}, 2)) ELSE high0 END AS high,
         medium FROM th0),
pred AS (
  SELECT sc.*, CASE WHEN risk_score_full >= th.high THEN 'High' WHEN risk_score_full >= th.medium THEN 'Medium'
                    ELSE 'Low' END AS risk_tier
  FROM sc CROSS JOIN th),
seg AS (SELECT *, {segment_case()} AS segment FROM pred),
edges AS (
  SELECT quantile_cont(CAST(total_revenue AS DOUBLE), 1.0 / 3) AS e1, quantile_cont(CAST(total_revenue AS DOUBLE), 2.0 / 3) AS e2
  FROM sc WHERE has_transactions_data = 1),
vt AS (
  SELECT seg.*, CASE WHEN has_transactions_data <> 1 THEN {_str(C.VALUE_UNKNOWN)}
                     WHEN total_revenue <= edges.e1 THEN 'Low' WHEN total_revenue <= edges.e2 THEN 'Medium'
                     ELSE 'High' END AS value_tier
  FROM seg CROSS JOIN edges),
act0 AS (SELECT *, {recommend_case()} AS recommendation FROM vt),
act AS (
  SELECT *, {intensity_case('recommendation')} AS intervention_intensity,
         CASE WHEN risk_tier IN ('High', 'Medium') AND segment = {_str(C.STABLE_MONITOR)}
              THEN {_str(C.UNMATCHED_AT_RISK)} ELSE segment END AS priority_group
  FROM act0)
"""


def q(body: str, round_: str = "v2") -> str:
    return chain(round_) + body


def order_values(name: str, values: list[str]) -> str:
    rows = ", ".join(f"({_str(v)}, {i + 1})" for i, v in enumerate(values))
    return f"(SELECT * FROM (VALUES {rows}) t({name}, {name}_order))"


def _calib_model_sql(m: str, score: str) -> str:
    return f"""
fb_{m} AS (SELECT CAST({score} AS DOUBLE) AS x, COUNT(*) * 1.0 AS n, SUM(is_churn) * 1.0 AS pos
           FROM cs WHERE calib_split = 'calib_fit' GROUP BY 1),
cb_{m} AS (SELECT *, SUM(pos) OVER (ORDER BY x) AS S, SUM(n) OVER (ORDER BY x) AS W, ROW_NUMBER() OVER (ORDER BY x) AS i
           FROM fb_{m}),
iso_{m} AS (SELECT i, x, MAX(mn) AS fit FROM (
              SELECT a.i, a.x, b.i AS j, MIN((c.S - b.S + b.pos) / (c.W - b.W + b.n)) AS mn
              FROM cb_{m} a JOIN cb_{m} b ON b.i <= a.i JOIN cb_{m} c ON c.i >= a.i GROUP BY a.i, a.x, b.i)
            GROUP BY i, x),
seg_{m} AS (SELECT x AS x0, fit AS y0, LEAD(x) OVER (ORDER BY x) AS x1, LEAD(fit) OVER (ORDER BY x) AS y1 FROM iso_{m}),
ends_{m} AS (SELECT MIN(x) AS xmin, MAX(x) AS xmax, arg_min(fit, x) AS ymin, arg_max(fit, x) AS ymax FROM iso_{m}),
nt_{m}(it, w, b) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)
  UNION ALL
  SELECT it + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb)
  FROM (SELECT it, w, b, SUM((n * p - pos) * x) + w AS gw, SUM(n * p - pos) AS gb,
               SUM(n * p * (1 - p) * x * x) + 1 AS hww, SUM(n * p * (1 - p) * x) AS hwb, SUM(n * p * (1 - p)) AS hbb
        FROM (SELECT nt_{m}.it, nt_{m}.w, nt_{m}.b, fb_{m}.x, fb_{m}.n, fb_{m}.pos,
                     1.0 / (1.0 + exp(-(nt_{m}.w * fb_{m}.x + nt_{m}.b))) AS p
              FROM nt_{m}, fb_{m} WHERE nt_{m}.it < 40) z
        GROUP BY it, w, b) y),
platt_{m} AS (SELECT w, b FROM nt_{m} ORDER BY it DESC LIMIT 1),
ap_{m} AS (
  SELECT cs.msno, 1.0 / (1.0 + exp(-((SELECT w FROM platt_{m}) * {score} + (SELECT b FROM platt_{m})))) AS sig,
         CASE WHEN {score} <= e.xmin THEN e.ymin WHEN {score} >= e.xmax THEN e.ymax
              WHEN g.x1 = g.x0 THEN g.y0 ELSE g.y0 + ({score} - g.x0) * (g.y1 - g.y0) / (g.x1 - g.x0) END AS iso
  FROM cs CROSS JOIN ends_{m} e LEFT JOIN seg_{m} g ON {score} >= g.x0 AND {score} < g.x1),
cmp_{m} AS (
  SELECT '{m}' AS model, AVG(({score} - is_churn) ^ 2) AS raw, AVG((sig - is_churn) ^ 2) AS sigmoid,
         AVG((iso - is_churn) ^ 2) AS isotonic, COUNT(*) AS n_eval
  FROM cs JOIN ap_{m} USING (msno) WHERE calib_split = 'calib_eval'),
win_{m} AS (SELECT CASE WHEN isotonic < sigmoid THEN 'isotonic' ELSE 'sigmoid' END AS winner FROM cmp_{m})"""


def calib_chain() -> str:
    """Extra CTEs (append after :func:`chain`): calibration split, isotonic fit by
    the max-min formula over fit-half score blocks, Platt fit by Newton
    iterations in a recursive CTE, eval-half comparison, winner, and ``cal``
    (pred + calib_split + both calibrated probabilities)."""
    return f""",
cs AS (SELECT pred.*, CASE WHEN {hash_u("msno || 'calib'")} < 0.5 THEN 'calib_fit' ELSE 'calib_eval' END AS calib_split FROM pred),
{_calib_model_sql('full', 'risk_score_full')},
{_calib_model_sql('proxy_controlled', 'risk_score_proxy_controlled')},
cal AS (
  SELECT cs.*, CASE WHEN (SELECT winner FROM win_full) = 'sigmoid' THEN f.sig ELSE f.iso END AS calibrated_probability,
         CASE WHEN (SELECT winner FROM win_proxy_controlled) = 'sigmoid' THEN p.sig ELSE p.iso END
           AS calibrated_probability_proxy_controlled
  FROM cs JOIN ap_full f USING (msno) JOIN ap_proxy_controlled p USING (msno))
"""


def qc(body: str, round_: str = "v2") -> str:
    """Chain + calibration CTEs + body (body may continue the WITH list with ', name AS ...')."""
    return chain(round_).rstrip() + calib_chain() + body
