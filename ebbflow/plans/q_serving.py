"""Registered queries: the customer lookup and the queries behind the manager tools
(B21, B23-B25, B27, B29-B33, C5, C10-C12, D26-D28, D32, D35, D39, D44, E3, F1, F2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions import expr as X
from ebbflow.operators import segments as SG
from ebbflow.operators import serving as SV
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import _str, qc
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.q_segments import PLAN_SQL
from ebbflow.plans.registry import register

LK_SQL = f"""
, lk AS (
  SELECT s.msno, s.is_churn, s.risk_tier,
         CASE WHEN s.risk_tier IN ('High', 'Medium') AND s.segment = {_str(C.STABLE_MONITOR)} THEN {_str(C.UNMATCHED_AT_RISK)}
              ELSE s.segment END AS segment, s.segment AS segment_file_label,
         {", ".join("s." + c for c in C.CHAR_COLS)}, r.risk_score_full, v.total_revenue, v.value_tier, c.calibrated_probability
  FROM seg s LEFT JOIN pred r ON r.msno = s.msno LEFT JOIN vt v ON v.msno = s.msno LEFT JOIN cal c ON c.msno = s.msno)"""
LK_D = ["auto_renew_pct", "avg_revenue_per_txn", "discount_rate", "cancel_rate", "calibrated_probability"]


def ql(body: str) -> str:
    return qc(LK_SQL + body)


def _lk(spark, sf):
    return Chain.shared(spark, sf).lookup()


def _signal_sql():
    return ("CASE WHEN latest_is_auto_renew IS NULL AND days_since_last_txn IS NULL AND cancel_rate IS NULL "
            "THEN 'Limited transaction history' WHEN latest_is_auto_renew = 0 THEN 'Auto-renew OFF' "
            "WHEN days_since_last_txn > 30 THEN 'Inactive 30+ days' WHEN cancel_rate > 0.05 THEN 'Elevated cancellation history' "
            "ELSE 'Multiple smaller signals' END")


def _action_sql(seg="segment"):
    whens = " ".join(f"WHEN {seg} = {_str(k)} THEN {_str(v)}" for k, v in SV.SHORT_ACTION_BY_SEGMENT.items())
    return f"COALESCE(CASE {whens} END, 'Standard outreach')"


@register("customer_360", sql_final(ql("\nSELECT * FROM lk"), LK_D))
def customer_360(spark, sf):
    """Segments + risk + value + calibrated probability, residual relabel applied."""
    return finalize(_lk(spark, sf))


@register("key_risk_signal", ql(f"\nSELECT msno, {_signal_sql()} AS key_risk_signal FROM lk"))
def key_risk_signal(spark, sf):
    """One behavioural flag per customer in precedence order."""
    return _lk(spark, sf).select("msno", X.key_risk_signal().alias("key_risk_signal"))


@register("id_search", ql("\nSELECT msno, risk_tier, segment FROM lk WHERE contains(lower(msno), lower('C+12'))"))
def id_search(spark, sf):
    """Case-insensitive literal substring search on the key ('+' is not a regex here)."""
    return SV.filter_lookup(_lk(spark, sf), search="C+12").select("msno", "risk_tier", "segment")


@register("customer_lookup", sql_final(ql("\nSELECT * FROM lk WHERE msno = 'C+10/='"), LK_D))
def customer_lookup(spark, sf):
    """Exact-key profile; missing fields stay NULL; unknown key -> zero rows."""
    return finalize(_lk(spark, sf).where(F.col("msno") == "C+10/="))


@register("customer_by_key", sql_final(ql("\nSELECT * FROM lk WHERE msno = 'C+10/='"), LK_D))
def customer_by_key(spark, sf):
    """B32 over the key-ordered stage: bounds and bloom filters leave one row group to read."""
    return finalize(Chain.shared(spark, sf).lookup_by_key().where(F.col("msno") == "C+10/="))


@register("id_search_postings", ql("\nSELECT msno, risk_tier, segment FROM lk WHERE contains(lower(msno), lower('C+12'))"))
def id_search_postings(spark, sf):
    """B23 over posting lists: the needle's shortest trigram list, checked exactly."""
    return Chain.shared(spark, sf).search_key("C+12")


@register("range_keep_null", ql("\nSELECT msno, total_revenue FROM lk WHERE total_revenue BETWEEN 50 AND 300 OR total_revenue IS NULL"))
def range_keep_null(spark, sf):
    """Inclusive revenue range, customers without revenue kept."""
    return _lk(spark, sf).where(X.range_keep_null("total_revenue", 50, 300)).select("msno", "total_revenue")


SEARCH_ARGS = dict(risk_tier=["High", "Medium"], min_risk_score=0.3, auto_renew=False, limit=50)
SR_COLS = ("msno, risk_tier, value_tier, risk_score_full AS model_risk_score, calibrated_probability, "
           "CAST(total_revenue AS DOUBLE) AS historical_realized_revenue_ntd, segment, "
           f"{_signal_sql()} AS key_risk_signal, {_action_sql()} AS recommended_action")


@register("search_customers", sql_final(ql(f"""
, f AS (SELECT * FROM lk WHERE risk_tier IN ('High', 'Medium') AND risk_score_full >= 0.3 AND latest_is_auto_renew = 0)
SELECT {SR_COLS}, (SELECT CAST(COUNT(*) AS BIGINT) FROM f) AS total_matches
FROM f ORDER BY risk_score_full DESC NULLS LAST, msno LIMIT 50"""), ["calibrated_probability"]))
def search_customers(spark, sf):
    """Predicate list + total matches + top rows (preset: elevated tiers, score >= 0.3, auto-renew off)."""
    total, rows = SV.search_customers(_lk(spark, sf), **SEARCH_ARGS)
    return finalize(rows.withColumn("total_matches", F.lit(total).cast("bigint")))


@register("contact_first", sql_final(ql(f"\nSELECT {SR_COLS} FROM lk WHERE risk_tier = 'High' "
                                        "ORDER BY risk_score_full DESC NULLS LAST, msno LIMIT 10"), ["calibrated_probability"]))
def contact_first(spark, sf):
    """F2: High tier, top 10 by score."""
    return finalize(SV.search_customers(_lk(spark, sf), risk_tier="High", limit=10)[1])


@register("priority_zone", sql_final(ql(f"\nSELECT {SR_COLS} FROM lk WHERE risk_tier = 'High' AND value_tier = 'High' "
                                        "ORDER BY risk_score_full DESC NULLS LAST, msno LIMIT 10"), ["calibrated_probability"]))
def priority_zone(spark, sf):
    """F2: High risk x High value, top 10 by score."""
    return finalize(SV.search_customers(_lk(spark, sf), risk_tier="High", value_tier="High", limit=10)[1])


@register("priority_queue", ql(f"""
SELECT msno, risk_tier, value_tier, risk_score_full, {_signal_sql()} AS key_risk_signal,
       CASE WHEN risk_tier IN ('High', 'Medium') AND segment_file_label = 'Stable / Monitor' THEN {_action_sql()} || ' †'
            ELSE {_action_sql()} END AS recommended_action
FROM lk WHERE risk_tier IN ('High', 'Medium') ORDER BY risk_score_full DESC NULLS LAST, msno LIMIT 500"""))
def priority_queue(spark, sf):
    """F1: default page filters (High, Medium) -> top 500 by score -> signal / action."""
    return SV.priority_queue(_lk(spark, sf))


@register("queue_composition", ql("\nSELECT risk_tier, value_tier, CAST(COUNT(*) AS BIGINT) AS n FROM lk "
                                  "WHERE risk_tier IN ('High', 'Medium') GROUP BY ALL"))
def queue_composition(spark, sf):
    """Risk x value make-up of the filtered list."""
    return SV.queue_composition(SV.filter_lookup(_lk(spark, sf), risk_tiers=("High", "Medium")))


BASE_SQL = ("\n, pop AS (SELECT AVG(latest_is_auto_renew) AS auto_renew_pct, median(tenure_days_at_cutoff) AS tenure_days_median, "
            "AVG(total_transactions) AS total_transactions_mean, AVG(cancel_rate) AS cancel_rate_mean, "
            "AVG(discount_rate) AS discount_rate_mean, AVG(days_since_last_txn) AS days_since_last_txn_mean FROM lk)")
BASE_D = ["auto_renew_pct", "tenure_days_median", "total_transactions_mean", "cancel_rate_mean", "discount_rate_mean",
          "days_since_last_txn_mean"]


@register("population_baselines", sql_final(ql(BASE_SQL + "\nSELECT * FROM pop"), BASE_D))
def population_baselines(spark, sf):
    """Population means and median tenure."""
    return finalize(SV.population_baselines(_lk(spark, sf)))


@register("baseline_cross_join", sql_final(ql(BASE_SQL + """
SELECT lk.msno, lk.latest_is_auto_renew, pop.auto_renew_pct AS pop_auto_renew_pct, lk.days_since_last_txn,
       pop.days_since_last_txn_mean AS pop_days_since_last_txn_mean, lk.cancel_rate, pop.cancel_rate_mean AS pop_cancel_rate_mean,
       lk.tenure_days_at_cutoff, pop.tenure_days_median AS pop_tenure_days_median
FROM lk CROSS JOIN pop"""), ["pop_auto_renew_pct", "pop_days_since_last_txn_mean", "cancel_rate", "pop_cancel_rate_mean",
                             "pop_tenure_days_median"]))
def baseline_cross_join(spark, sf):
    """Each customer beside the population scalars (scalars passed as literals)."""
    lk = _lk(spark, sf)
    b = SV.population_baselines(lk).first().asDict()  # one row of six numbers
    return finalize(lk.select(
        "msno", "latest_is_auto_renew", F.lit(b["auto_renew_pct"]).alias("pop_auto_renew_pct"), "days_since_last_txn",
        F.lit(b["days_since_last_txn_mean"]).alias("pop_days_since_last_txn_mean"), "cancel_rate",
        F.lit(b["cancel_rate_mean"]).alias("pop_cancel_rate_mean"), "tenure_days_at_cutoff",
        F.lit(b["tenure_days_median"]).cast("double").alias("pop_tenure_days_median")))


def _dev_sql():
    a = SV.DEV_AUTO_RENEW.replace("{pct}", "' || printf('%.0f', pop.auto_renew_pct * 100) || '").replace("'s strongest", "''s strongest")
    r = (SV.DEV_RECENCY.replace("{days}", "' || printf('%.0f', CAST(lk.days_since_last_txn AS DOUBLE)) || '")
         .replace("{mean}", "' || printf('%.0f', pop.days_since_last_txn_mean) || '"))
    c = (SV.DEV_CANCEL.replace("{rate}", "' || printf('%.1f', lk.cancel_rate * 100) || '")
         .replace("{mean}", "' || printf('%.1f', pop.cancel_rate_mean * 100) || '"))
    return f"""
SELECT msno, CASE WHEN len(arr) = 0 THEN ['{SV.DEV_NONE}'] ELSE arr END AS deviations FROM (
  SELECT lk.msno, list_filter([CASE WHEN lk.latest_is_auto_renew = 0 THEN '{a}' END,
                               CASE WHEN lk.days_since_last_txn > pop.days_since_last_txn_mean * 1.5 THEN '{r}' END,
                               CASE WHEN lk.cancel_rate > pop.cancel_rate_mean * 1.5 THEN '{c}' END], lambda x: x IS NOT NULL) AS arr
  FROM lk CROSS JOIN pop)"""


@register("customer_deviations", ql(BASE_SQL + _dev_sql()))
def customer_deviations(spark, sf):
    """Deviation sentences per customer against the population baselines."""
    lk = _lk(spark, sf)
    return SV.customer_deviations(lk, SV.population_baselines(lk).first().asDict())


@register("kpi_metrics", sql_final(ql("""
SELECT CAST(COUNT(*) AS BIGINT) AS n_customers_scored, AVG(is_churn) * 100.0 AS overall_churn_rate_pct,
       CAST(COUNT(*) FILTER (WHERE risk_tier = 'High') AS BIGINT) AS high_risk_customers,
       CAST(COUNT(*) FILTER (WHERE risk_tier = 'Medium') AS BIGINT) AS medium_risk_customers,
       CAST(COUNT(*) FILTER (WHERE risk_tier = 'Low') AS BIGINT) AS low_risk_customers,
       CAST(COUNT(*) FILTER (WHERE risk_tier IN ('High', 'Medium')) AS BIGINT) AS elevated_risk_customers,
       CAST(COUNT(*) FILTER (WHERE risk_tier = 'High' AND value_tier = 'High') AS BIGINT) AS high_risk_high_value_customers,
       CAST(SUM(total_revenue) FILTER (WHERE value_tier <> 'Unknown (no transaction data)') AS BIGINT) AS total_realized_revenue,
       CAST(SUM(total_revenue) FILTER (WHERE risk_tier = 'High' AND value_tier <> 'Unknown (no transaction data)') AS BIGINT)
         AS high_risk_revenue_exposure
FROM lk"""), ["overall_churn_rate_pct"]))
def kpi_metrics(spark, sf):
    """D26 + D27: headline KPIs in one conditional aggregation."""
    return finalize(SV.kpi_metrics(_lk(spark, sf)))


EXPO_D = ["exposure_100pct", "score_weighted", "calibrated_weighted", "difference"]


@register("exposure_vs_weighted", sql_final(ql("""
, e AS (SELECT CAST(COUNT(*) FILTER (WHERE risk_tier = 'High') AS BIGINT) AS n_high,
               SUM(CAST(total_revenue AS DOUBLE)) FILTER (WHERE risk_tier = 'High' AND value_tier <> 'Unknown (no transaction data)') AS exposure_100pct,
               SUM(total_revenue * risk_score_full) FILTER (WHERE risk_tier = 'High' AND value_tier <> 'Unknown (no transaction data)') AS score_weighted,
               SUM(total_revenue * calibrated_probability) FILTER (WHERE risk_tier = 'High' AND value_tier <> 'Unknown (no transaction data)') AS calibrated_weighted
        FROM lk)
SELECT *, exposure_100pct - calibrated_weighted AS difference FROM e"""), EXPO_D))
def exposure_vs_weighted(spark, sf):
    """100 %-weight High-tier exposure vs probability-weighted sums."""
    return finalize(SV.revenue_exposure(_lk(spark, sf)))


@register("revenue_exposure", sql_final(qc(", rvm AS (SELECT risk_tier, value_tier, COUNT(*) AS n, AVG(CAST(total_revenue AS DOUBLE)) AS avg_hrr "
                                           "FROM vt GROUP BY ALL)\nSELECT SUM(n * avg_hrr) AS high_risk_revenue_exposure FROM rvm "
                                           "WHERE risk_tier = 'High' AND value_tier IN ('Low', 'Medium', 'High')"),
                                        ["high_risk_revenue_exposure"]))
def revenue_exposure(spark, sf):
    """Exposure recomputed from the matrix cells: sum over value tiers of n x mean revenue (High row)."""
    m = SG.risk_value_matrix(Chain.shared(spark, sf).value_tiers()).where(F.col("risk_tier") == "High")
    expr = sum((F.col(f"n_{v}") * F.coalesce(F.col(f"avg_hrr_{v}"), F.lit(0.0)) for v in C.TIER_ORDER), F.lit(0.0))
    return finalize(m.select(expr.alias("high_risk_revenue_exposure")))


@register("currency_display", sql_final(ql("\nSELECT msno, total_revenue, total_revenue * CAST(2.62 AS DOUBLE) AS revenue_display, "
                                           "total_revenue * CAST(2.62 AS DOUBLE) / CAST(2.62 AS DOUBLE) AS revenue_round_trip FROM lk"),
                                        ["revenue_display", "revenue_round_trip"]))
def currency_display(spark, sf):
    """Native -> display currency and back."""
    lk = _lk(spark, sf)
    return finalize(lk.select("msno", "total_revenue", X.to_display_currency("total_revenue").alias("revenue_display"),
                              X.from_display_currency(X.to_display_currency("total_revenue")).alias("revenue_round_trip")))


@register("format_columns", ql("""
SELECT msno,
       CASE WHEN total_revenue IS NULL THEN '—' WHEN abs(total_revenue) >= 1e9 THEN printf('%.2f', total_revenue / 1e9) || 'B'
            WHEN abs(total_revenue) >= 1e6 THEN printf('%.2f', total_revenue / 1e6) || 'M'
            WHEN abs(total_revenue) >= 1e3 THEN printf('%.1f', total_revenue / 1e3) || 'K'
            ELSE format('{:,.0f}', CAST(total_revenue AS DOUBLE)) END AS revenue_compact,
       printf('%.1f', risk_score_full * 100) || '%' AS score_percent,
       CASE WHEN calibrated_probability IS NULL THEN '—'
            WHEN printf('%.0f', calibrated_probability * 100) = '100' THEN '>99%'
            WHEN printf('%.0f', calibrated_probability * 100) IN ('0', '-0') THEN '<1%'
            ELSE printf('%.0f', calibrated_probability * 100) || '%' END AS probability_display
FROM lk"""))
def format_columns(spark, sf):
    """Compact counts, percents and probability labels (half-to-even)."""
    lk = _lk(spark, sf)
    return lk.select("msno", X.fmt_compact_count("total_revenue").alias("revenue_compact"),
                     X.fmt_percent(F.col("risk_score_full") * 100).alias("score_percent"),
                     X.fmt_probability("calibrated_probability").alias("probability_display"))


FEATURES_FOR_NAMES = C.BINARY_FLAGS + C.NUMERIC_CONTINUOUS


def _display_sql():
    whens = " ".join(f"WHEN col_name = {_str(k)} THEN {_str(v)}" for k, v in SV.FEATURE_DISPLAY_NAMES.items())
    fallback = "upper(substr(replace(col_name, '_', ' '), 1, 1)) || lower(substr(replace(col_name, '_', ' '), 2))"
    return f"COALESCE(CASE {whens} END, {fallback})"


@register("feature_display_name", qc("\nSELECT col_name AS feature, " + _display_sql() + " AS display_name FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name FROM ds HAVING COUNT({c}) > 0" for c in FEATURES_FOR_NAMES) + ")"))
def feature_display_name(spark, sf):
    """Display names of the features observed in the modeling table (map, else
    underscores to spaces and first letter capitalised)."""
    ds = Chain.shared(spark, sf).dataset()
    # one wide aggregate; a row per feature follows from its single row
    seen = ds.agg(*[F.count(c).alias(c) for c in FEATURES_FOR_NAMES]).unpivot([], FEATURES_FOR_NAMES, "feature", "n")
    present = seen.where(F.col("n") > 0)
    m = F.create_map(*[F.lit(x) for kv in SV.FEATURE_DISPLAY_NAMES.items() for x in kv])
    return present.select("feature", F.coalesce(F.element_at(m, F.col("feature")),
                                                X.feature_display_fallback("feature")).alias("display_name"))


RATIONALE = SG.RATIONALE


@register("rationale_text", qc(PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1) + """
SELECT priority_group, format('{:,}', n_customers) || ' customers (' || printf('%.2f', pct_of_base) || '% of base) with a '
       || printf('%.1f', churn_rate_pct) || '% actual churn rate and ' || format('{:,.0f}', total_HRR)
       || ' NT$ in Historical Realized Revenue among them (median ' || format('{:,.0f}', median_HRR) || ' NT$/customer). '
       || printf('%.0f', pct_matching_dominant_recommendation) || '% of this group falls into the '''
       || dominant_risk_value_recommendation || ''' cell of the risk x value framework, '
       || 'which sets the recommended intensity below.' AS rationale
FROM plan WHERE n_customers > 0"""))
def rationale_text(spark, sf):
    """Templated rationale per action-plan group (thousands separators, fixed decimals)."""
    plan = SG.action_plan(Chain.shared(spark, sf).customer_actions()).where(F.col("n_customers") > 0)
    return plan.select("priority_group", SG.rationale(plan).alias("rationale"))


SEG_MED_SQL = f"""
, segmed AS (
  SELECT CASE WHEN priority_group = {_str(C.UNMATCHED_AT_RISK)} THEN 'UNMATCHED (Medium/High risk, no segment)'
              ELSE priority_group END AS label,
         median(CAST(days_since_last_txn AS DOUBLE)) AS median_days_since_last_txn,
         median(CAST(tenure_days_at_cutoff AS DOUBLE)) AS median_tenure_days,
         AVG(latest_is_auto_renew) * 100.0 AS auto_renew_rate_pct
  FROM act WHERE priority_group <> {_str(C.STABLE_MONITOR)} GROUP BY 1)"""


@register("segment_context", sql_final(qc(PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1) + SEG_MED_SQL + f"""
SELECT p.priority_group AS segment, p.n_customers, p.pct_of_base, p.churn_rate_pct, p.total_HRR, p.median_HRR,
       p.intervention_intensity, s.median_days_since_last_txn, s.median_tenure_days, s.auto_renew_rate_pct
FROM plan p LEFT JOIN segmed s
  ON s.label = CASE WHEN p.priority_group = {_str(C.UNMATCHED_AT_RISK)} THEN 'UNMATCHED (Medium/High risk, no segment)'
                    ELSE p.priority_group END"""),
    ["pct_of_base", "churn_rate_pct", "total_HRR", "median_HRR", "median_days_since_last_txn", "median_tenure_days",
     "auto_renew_rate_pct"]))
def segment_context(spark, sf):
    """C11: action-plan row beside the behavioural medians of the segment summary,
    joined through the summary's label alias; a group the summary lacks gets NULLs."""
    from ebbflow.operators import segments as S2
    acts = Chain.shared(spark, sf).customer_actions()
    plan = S2.action_plan(acts)
    return finalize(S2.segment_context(plan, S2.segment_medians(acts)))


@register("compare_to_champions", sql_final(qc(PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1) + f"""
, champ AS (SELECT p.churn_rate_pct AS champions_churn_rate_pct,
                   (SELECT median(CAST(total_revenue AS DOUBLE)) FROM vt WHERE has_transactions_data = 1 AND segment = {_str(C.CHAMPIONS)})
                     AS champions_median_hrr
            FROM plan p WHERE p.priority_group = {_str(C.CHAMPIONS)})
SELECT p.priority_group AS segment, p.churn_rate_pct AS subject_churn_rate_pct, p.total_HRR AS subject_total_hrr,
       champ.champions_churn_rate_pct, champ.champions_median_hrr
FROM plan p CROSS JOIN champ"""), ["subject_churn_rate_pct", "subject_total_hrr", "champions_churn_rate_pct",
                                   "champions_median_hrr"]))
def compare_to_champions(spark, sf):
    """Each priority group beside the Champions benchmark (churn %, median revenue)."""
    from ebbflow.operators import segments as S2
    ch = Chain.shared(spark, sf)
    plan = S2.action_plan(ch.customer_actions())
    vbs = S2.value_by_segment(ch.value_tiers())
    return finalize(S2.compare_to_champions(plan, vbs))


@register("highest_value_segment", sql_final(qc("\nSELECT arg_max(segment, total) AS segment, MAX(total) AS total_hrr FROM "
                                                "(SELECT segment, CAST(SUM(total_revenue) AS DOUBLE) AS total FROM vt "
                                                "WHERE has_transactions_data = 1 GROUP BY segment)"), ["total_hrr"]))
def highest_value_segment(spark, sf):
    """Segment with the largest total revenue (argmax)."""
    vbs = SG.value_by_segment(Chain.shared(spark, sf).value_tiers())
    return finalize(vbs.agg(F.max_by("segment", "total_HRR").alias("segment"),
                            F.max("total_HRR").cast("double").alias("total_hrr")))


@register("intervention_totals", sql_final(qc(PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1) + """
SELECT CAST((SELECT COUNT(*) FROM act) AS BIGINT) AS customers_analyzed,
       CAST((SELECT SUM(n_customers) FROM plan WHERE priority_group NOT IN ('Engaged Low-Risk (Champions)', 'Stable / Monitor')) AS BIGINT)
         AS customers_requiring_intervention,
       CAST((SELECT COUNT(*) FROM act WHERE value_tier = 'High') AS BIGINT) AS high_value_customers,
       CAST((SELECT COUNT(*) FROM act WHERE risk_tier = 'High' AND value_tier = 'High') AS BIGINT) AS save_first,
       (SELECT SUM(n_customers) FROM plan WHERE priority_group NOT IN ('Engaged Low-Risk (Champions)', 'Stable / Monitor'))
         * 100.0 / (SELECT COUNT(*) FROM act) AS intervention_share_pct,
       (SELECT COUNT(*) FROM act WHERE risk_tier = 'High' AND value_tier = 'High') * 100.0 / (SELECT COUNT(*) FROM act) AS save_first_share_pct"""),
    ["intervention_share_pct", "save_first_share_pct"]))
def intervention_totals(spark, sf):
    """Customers in retention groups, high-value count, funnel stages and shares."""
    acts = Chain.shared(spark, sf).customer_actions()
    retention = ~F.col("priority_group").isin(*C.NON_RETENTION_GROUPS)
    a = acts.agg(F.count(F.lit(1)).alias("customers_analyzed"),
                 F.count_if(retention).alias("customers_requiring_intervention"),
                 F.count_if(F.col("value_tier") == "High").alias("high_value_customers"),
                 F.count_if((F.col("risk_tier") == "High") & (F.col("value_tier") == "High")).alias("save_first"))
    return finalize(a.withColumn("intervention_share_pct", F.col("customers_requiring_intervention") * 100.0 / F.col("customers_analyzed"))
                    .withColumn("save_first_share_pct", F.col("save_first") * 100.0 / F.col("customers_analyzed")))


@register("segment_priority_rank", sql_final(qc(PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1) + f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY total_HRR DESC, priority_group) AS INTEGER) AS priority, priority_group AS segment,
       n_customers, churn_rate_pct, total_HRR AS total_hrr, intervention_intensity, {_action_sql('priority_group')} AS recommended_action
FROM plan WHERE priority_group NOT IN ('Engaged Low-Risk (Champions)', 'Stable / Monitor')"""), ["churn_rate_pct", "total_hrr"]))
def segment_priority_rank(spark, sf):
    """Retention groups ranked 1..n by revenue with their short action."""
    plan = SG.action_plan(Chain.shared(spark, sf).customer_actions())
    r = SG.priority_opportunities(plan)
    return finalize(r.select(F.col("priority_rank").alias("priority"), F.col("priority_group").alias("segment"),
                             "n_customers", "churn_rate_pct", F.col("total_HRR").alias("total_hrr"),
                             "intervention_intensity",
                             SV._map(SV.SHORT_ACTION_BY_SEGMENT, F.col("priority_group"), "Standard outreach")
                             .alias("recommended_action")))


__all__ = ["Window"]


def _text_case(texts: dict, col: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_str(k)} THEN {_str(v)}" for k, v in texts.items()) + f" ELSE {_str(default)} END"


_RECOMMEND = (f"{_text_case(SV.SHORT_ACTION_BY_SEGMENT, 'g', 'Standard outreach')} AS recommended_action, "
              f"{_text_case(SV.SHORT_WHY_BY_SEGMENT, 'g', 'Elevated model risk for this segment.')} AS why, "
              f"{_text_case(SV.AVOID_BY_SEGMENT, 'g', '')} AS avoid")
_PLAN = PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1)


@register("recommend_action", qc(_PLAN + f"""
SELECT g AS segment, objective, intervention_intensity, {_RECOMMEND}
FROM (SELECT priority_group AS g, intervention_intensity,
             {_text_case({k: v[2] for k, v in SG.PLAN_TEXTS.items()}, 'priority_group', '')} AS objective FROM plan)"""))
def recommend_action(spark, sf):
    """Per segment the recommended action, objective, intensity, why and what to avoid
    (the rationale text is in ``marketing_action_plan``)."""
    plan = SG.action_plan_full(Chain.shared(spark, sf).customer_actions())
    return SV.recommendations(plan).drop("rationale")


@register("recommend_action_customer", ql(", pl AS (SELECT * FROM (" + f"""
SELECT msno, g AS segment, {_RECOMMEND} FROM (SELECT msno, segment AS g FROM lk)))
SELECT pl.* FROM pl"""))
def recommend_action_customer(spark, sf):
    """B20 for customers: the recommendation of each customer's segment."""
    ch = Chain.shared(spark, sf)
    rec = SV.recommendations(SG.action_plan_full(ch.customer_actions()))
    return SV.customer_recommendations(ch.lookup(), rec).drop("intervention_intensity")


@register("kpi_by_segment", sql_final(qc(_PLAN + "\nSELECT priority_group AS segment, CAST(COALESCE(n_customers, 0) AS BIGINT) AS n_customers, "
                                         "churn_rate_pct, total_HRR FROM plan"), ["churn_rate_pct", "total_HRR"]))
def kpi_by_segment(spark, sf):
    """The by-segment list of the KPI tool, seven rows."""
    plan = SG.action_plan(Chain.shared(spark, sf).customer_actions())
    return finalize(plan.select(F.col("priority_group").alias("segment"), F.coalesce("n_customers", F.lit(0)).cast("bigint").alias("n_customers"),
                                "churn_rate_pct", "total_HRR"))


@register("kpi_by_tier", sql_final(ql("""
SELECT risk_tier AS tier, CAST(COUNT(*) AS BIGINT) AS n_customers, COUNT(*) * 100.0 / (SELECT COUNT(*) FROM lk) AS pct_of_base,
       AVG(is_churn) * 100.0 AS observed_churn_rate_pct FROM lk GROUP BY risk_tier"""), ["pct_of_base", "observed_churn_rate_pct"]))
def kpi_by_tier(spark, sf):
    """The risk-tier list of the KPI tool."""
    lk = _lk(spark, sf)
    tiers = lk.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n_customers"), (F.avg(F.col("is_churn").cast("double")) * 100.0).alias("rate"))
    share = F.col("n_customers") * 100.0 / F.sum("n_customers").over(Window.partitionBy())  # three rows
    return finalize(tiers.select(F.col("risk_tier").alias("tier"), "n_customers", share.alias("pct_of_base"), F.col("rate").alias("observed_churn_rate_pct")))


@register("compare_customer_to_champions", sql_final(ql(f"""
SELECT lk.msno, lk.calibrated_probability AS subject_calibrated_probability, CAST(lk.total_revenue AS DOUBLE) AS subject_hrr,
       (SELECT round(AVG(is_churn) * 100.0, 2) FROM act WHERE priority_group = {_str(C.CHAMPIONS)}) AS champions_churn_rate_pct,
       (SELECT median(CAST(total_revenue AS DOUBLE)) FROM vt WHERE has_transactions_data = 1 AND segment = {_str(C.CHAMPIONS)})
         AS champions_median_hrr
FROM lk"""), ["subject_calibrated_probability", "subject_hrr", "champions_churn_rate_pct", "champions_median_hrr"]))
def compare_customer_to_champions(spark, sf):
    """C12 for customers: each one beside the Champions benchmark."""
    ch = Chain.shared(spark, sf)
    bench = SG.compare_to_champions(SG.action_plan(ch.customer_actions()), SG.value_by_segment(ch.value_tiers()))
    return finalize(SV.compare_customers_to_champions(ch.lookup(), bench.first()))  # seven rows, the benchmark the same in each
