"""Scalar expressions (B-rows of the inventory).  All return ``Column`` objects so
they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbflow import config as C

__all__ = [
    "col_or", "safe_div", "yyyymmdd_to_date", "date_to_yyyymmdd", "day_diff", "hash_uniform",
    "clip_keep_null", "right_closed_bucket", "risk_tier", "segment_rule", "priority_group",
    "recommend_cell", "intensity_of", "key_risk_signal", "confusion_group", "id_search",
    "range_keep_null", "score_clip", "to_display_currency", "from_display_currency",
    "fmt_compact_count", "fmt_percent", "py_fixed", "py_grouped", "fmt_probability", "score_range_label",
    "feature_display_fallback", "question_intent", "segment_intent", "as_category", "round6",
]


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c: str | Column) -> Column:
    return F.round(col_or(c).cast("double"), 6)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Ratio with denominator 0 -> NULL (never 0, never an ANSI error)."""
    return F.try_divide(col_or(num).cast("double"), F.nullif(col_or(den).cast("double"), F.lit(0.0)))


def yyyymmdd_to_date(c: str | Column) -> Column:
    """Yyyymmdd integer -> DATE; malformed values become NULL."""
    return F.try_to_date(col_or(c).cast("string"), "yyyyMMdd")


def date_to_yyyymmdd(d: str | Column) -> Column:
    d = col_or(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def day_diff(end: str | Column, start: str | Column) -> Column:
    """Whole days between two yyyymmdd ints (end - start)."""
    return F.datediff(yyyymmdd_to_date(end), yyyymmdd_to_date(start))


def hash_uniform(*parts: str | Column) -> Column:
    """Deterministic uniform in [0,1): first 8 hex digits of md5(text) / 2^32.
    Stable under repartitioning, unlike ``rand(seed)``."""
    text = F.concat(*[col_or(p).cast("string") for p in parts]) if len(parts) > 1 else col_or(parts[0]).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def clip_keep_null(c: str | Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (least/greatest would skip it)."""
    x = col_or(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def right_closed_bucket(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals (e0,e1], (e1,e2] ...; outside or NULL -> NULL."""
    x = col_or(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def risk_tier(score: str | Column, medium: float | Column, high: float | Column) -> Column:
    """P >= high -> High; p >= medium -> Medium; else Low."""
    p = col_or(score)
    hi = high if isinstance(high, Column) else F.lit(high)
    md = medium if isinstance(medium, Column) else F.lit(medium)
    return F.when(p >= hi, "High").when(p >= md, "Medium").otherwise("Low")


def segment_rule(tier: str | Column = "risk_tier") -> Column:
    """Ordered first-match segment rules; a NULL comparison is false and falls
    through, exactly like a boolean mask that is False on NaN."""
    t = col_or(tier)
    at_risk = t.isin(*C.ELEVATED_TIERS)
    return (
        F.when(at_risk & (F.col("latest_is_auto_renew") == 0), C.SEGMENT_ORDER[0])
        .when(at_risk & (F.col("tenure_days_at_cutoff") >= C.SEGMENT_TENURE_VETERAN), C.SEGMENT_ORDER[1])
        .when(at_risk & (F.col("tenure_days_at_cutoff") < C.SEGMENT_TENURE_NEWCOMER), C.SEGMENT_ORDER[2])
        .when(at_risk & (F.col("discount_rate") > C.SEGMENT_DISCOUNT_RATE), C.SEGMENT_ORDER[3])
        .when((t == "Low") & (F.col("total_transactions") >= C.SEGMENT_CHAMPION_TXNS)
              & (F.col("latest_is_auto_renew") == 1), C.CHAMPIONS)
        .otherwise(C.STABLE_MONITOR)
    )


def priority_group(tier: str | Column = "risk_tier", segment: str | Column = "segment") -> Column:
    """Elevated-risk customers left in the default bucket become the
    unmatched residual group."""
    t, s = col_or(tier), col_or(segment)
    return F.when(t.isin(*C.ELEVATED_TIERS) & (s == C.STABLE_MONITOR), C.UNMATCHED_AT_RISK).otherwise(s)


# Recommendation texts of the risk x value rule and their intensity labels.
REC_HIGH_TOUCH = "High-touch (phone call, largest offer) -- top-priority cell"
REC_LOW_COST_CAPPED = "Low-cost only (email/automated) -- capped spend given limited value at stake"
REC_MODERATE = "Moderate-touch (proactive outreach before they become High-risk)"
REC_LOW_COST_AUTO = "Low-cost automated (email, in-app nudge)"
REC_ADVOCACY = "No retention spend -- redirect to advocacy/upsell (see Champions segment)"
REC_MONITOR = "No action -- monitor only"
REC_INSUFFICIENT = "Insufficient data (no transaction record)"
INTENSITY = {
    REC_HIGH_TOUCH: "High-touch",
    REC_MODERATE: "Moderate-touch",
    REC_LOW_COST_CAPPED: "Low-cost / Automated",
    REC_LOW_COST_AUTO: "Low-cost / Automated",
    REC_ADVOCACY: "Advocacy / Upsell (non-retention)",
    REC_MONITOR: "Monitor only",
    REC_INSUFFICIENT: "Monitor only (no value data)",
}


def recommend_cell(tier: str | Column = "risk_tier", value: str | Column = "value_tier") -> Column:
    """Risk x value recommendation; unknown value tier -> insufficient data."""
    r, v = col_or(tier), col_or(value)
    return (
        F.when(v == C.VALUE_UNKNOWN, REC_INSUFFICIENT)
        .when((r == "High") & v.isin("High", "Medium"), REC_HIGH_TOUCH)
        .when((r == "High") & (v == "Low"), REC_LOW_COST_CAPPED)
        .when((r == "Medium") & (v == "High"), REC_MODERATE)
        .when(r == "Medium", REC_LOW_COST_AUTO)
        .when((r == "Low") & (v == "High"), REC_ADVOCACY)
        .otherwise(REC_MONITOR)
    )


def intensity_of(rec: str | Column) -> Column:
    """B20 for the fixed 7-entry map: a literal map lookup (no join needed)."""
    m = F.create_map(*[F.lit(x) for kv in INTENSITY.items() for x in kv])
    return F.element_at(m, col_or(rec))


def key_risk_signal(auto: str | Column = "latest_is_auto_renew", recency: str | Column = "days_since_last_txn",
                    cancel: str | Column = "cancel_rate") -> Column:
    """One behavioural flag per customer, in precedence order."""
    a, d, c = col_or(auto), col_or(recency), col_or(cancel)
    return (
        F.when(a.isNull() & d.isNull() & c.isNull(), "Limited transaction history")
        .when(a == 0, "Auto-renew OFF")
        .when(d > C.RECENCY_FLAG_DAYS, "Inactive 30+ days")
        .when(c > C.CANCEL_FLAG_RATE, "Elevated cancellation history")
        .otherwise("Multiple smaller signals")
    )


def confusion_group(score: str | Column, label: str | Column, threshold: float = C.ERROR_ANALYSIS_THRESHOLD) -> Column:
    """TP / FP / FN / TN at a fixed threshold."""
    pred = col_or(score) >= F.lit(threshold)
    y = col_or(label) == 1
    return F.when(pred & y, "TP").when(pred, "FP").when(y, "FN").otherwise("TN")


def id_search(c: str | Column, needle: str) -> Column:
    """Case-insensitive literal substring (no regex); NULL -> no match."""
    return F.coalesce(F.lower(col_or(c)).contains(F.lit(needle.lower())), F.lit(False))


def range_keep_null(c: str | Column, lo: float, hi: float) -> Column:
    """Inclusive range or NULL."""
    x = col_or(c)
    return x.between(lo, hi) | x.isNull()


def score_clip(c: str | Column) -> Column:
    """Clip to [0, 1]; a missing score stays missing."""
    return clip_keep_null(col_or(c).cast("double"), 0.0, 1.0)


def to_display_currency(c: str | Column) -> Column:
    """Native -> display currency."""
    return col_or(c) * F.lit(C.CURRENCY_RATE)


def from_display_currency(c: str | Column) -> Column:
    return col_or(c) / F.lit(C.CURRENCY_RATE)


def py_fixed(x: Column, decimals: int) -> Column:
    """Python ``f"{x:.{d}f}"``: ``format_number`` rounds the exact binary value
    half-to-even (as Python does); its grouping commas are removed."""
    return F.regexp_replace(F.format_number(x, decimals), ",", "")


def py_grouped(x: Column, decimals: int) -> Column:
    """Python ``f"{x:,.{d}f}"`` (thousands separators)."""
    return F.format_number(x, decimals)


def fmt_compact_count(c: str | Column) -> Column:
    """1.23B / 4.56M / 7.8K / 1,234 style counts."""
    x = col_or(c).cast("double")
    ax = F.abs(x)
    return (
        F.when(x.isNull(), F.lit("—"))
        .when(ax >= 1e9, F.concat(py_fixed(x / 1e9, 2), F.lit("B")))
        .when(ax >= 1e6, F.concat(py_fixed(x / 1e6, 2), F.lit("M")))
        .when(ax >= 1e3, F.concat(py_fixed(x / 1e3, 1), F.lit("K")))
        .otherwise(py_grouped(x, 0))
    )


def fmt_percent(c: str | Column, decimals: int = 1) -> Column:
    """Value already in percent -> "12.3%"."""
    x = col_or(c).cast("double")
    return F.when(x.isNull(), F.lit("—")).otherwise(F.concat(py_fixed(x, decimals), F.lit("%")))


def fmt_probability(c: str | Column) -> Column:
    """Probability -> whole percent; a shown "0" becomes "<1%" and "100"
    becomes ">99%" (never a certainty); missing -> "—"."""
    p = col_or(c).cast("double")
    shown = py_fixed(p * 100, 0)
    return (
        F.when(p.isNull() | F.isnan(p), F.lit("—"))
        .when(shown == "100", F.lit(">99%"))
        .when(shown.isin("0", "-0"), F.lit("<1%"))
        .otherwise(F.concat(shown, F.lit("%")))
    )


def score_range_label(lo: str | Column, hi: str | Column) -> Column:
    """B36: "[lo, hi)" or "[lo, 1.00]" when the upper edge is the closed top."""
    lo_c, hi_c = col_or(lo), col_or(hi)
    lo_s = py_fixed(lo_c, 2)
    return F.when(hi_c < 1.01, F.concat(F.lit("["), lo_s, F.lit(", "), py_fixed(hi_c, 2), F.lit(")"))) \
        .otherwise(F.concat(F.lit("["), lo_s, F.lit(", 1.00]")))


def feature_display_fallback(c: str | Column) -> Column:
    """B31 fallback: underscores -> spaces, first letter upper, rest lower."""
    s = F.regexp_replace(col_or(c), "_", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20)))


def as_category(c: str | Column, numeric: bool = True) -> Column:
    """Categorical as string, missing becomes its own 'nan' category.  Numeric
    codes print as the float text the original got after its left joins ('3.0')."""
    x = col_or(c)
    text = F.format_string("%.1f", x.cast("double")) if numeric else x.cast("string")
    return F.when(x.isNull(), F.lit("nan")).otherwise(text)


# Keywords of the question router.  Customer intents, in match order:
#   discount: "discount" or "price"
#   compare_champions: "champion" or "compare"
#   what_if_nothing: "nothing" or "do nothing" or "no action"
#   worth_retaining: "worth retain" or "worth saving" or "worth it" or ("value" and "worth")
#   prioritized_reasons: "prioriti"
#   evidence_only: "evidence" or "support"
#   why_at_risk: "why" and "risk"
#   what_to_do: "what should we do" or "what to do" or "next" or "recommend"
#   why_at_risk: "why"
#   otherwise unknown
# Segment intents, in match order:
#   champions_importance: "champion" and ("important" or "why")
#   which_segment_priority: "prioriti" and ("which" or "segment")
#   high_touch_candidates: "high-touch" or "high touch" or "deserve"
#   otherwise segment_overview


def _has(t: Column, *words: str) -> Column:
    out = None
    for w in words:
        c = t.contains(F.lit(w))
        out = c if out is None else (out | c)
    return out


def question_intent(text: str | Column) -> Column:
    """First-match keyword tag of a customer question (lower-cased text)."""
    t = F.lower(col_or(text))
    return (
        F.when(_has(t, "discount", "price"), "discount")
        .when(_has(t, "champion", "compare"), "compare_champions")
        .when(_has(t, "nothing", "do nothing", "no action"), "what_if_nothing")
        .when(_has(t, "worth retain", "worth saving", "worth it") | (_has(t, "value") & _has(t, "worth")),
              "worth_retaining")
        .when(_has(t, "prioriti"), "prioritized_reasons")
        .when(_has(t, "evidence", "support"), "evidence_only")
        .when(_has(t, "why") & _has(t, "risk"), "why_at_risk")
        .when(_has(t, "what should we do", "what to do", "next", "recommend"), "what_to_do")
        .when(_has(t, "why"), "why_at_risk")
        .otherwise("unknown")
    )


def segment_intent(text: str | Column) -> Column:
    """First-match keyword tag of a segment question."""
    t = F.lower(col_or(text))
    return (
        F.when(_has(t, "champion") & _has(t, "important", "why"), "champions_importance")
        .when(_has(t, "prioriti") & _has(t, "which", "segment"), "which_segment_priority")
        .when(_has(t, "high-touch", "high touch", "deserve"), "high_touch_candidates")
        .otherwise("segment_overview")
    )
