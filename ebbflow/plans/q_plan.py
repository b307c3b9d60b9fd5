"""Registered query: the 13-column marketing action plan (D19 + B20 + B33)."""

from __future__ import annotations

from ebbflow.operators import segments as SG
from ebbflow.plans.common import finalize, sql_final
from ebbflow.plans.oracle import _str, qc
from ebbflow.plans.pipeline import Chain
from ebbflow.plans.q_segments import PLAN_SQL
from ebbflow.plans.registry import register


def _texts_sql() -> str:
    rows = ", ".join(f"({_str(k)}, {_str(a)}, {_str(b)}, {_str(c)})" for k, (a, b, c) in SG.PLAN_TEXTS.items())
    return f"(SELECT * FROM (VALUES {rows}) t(priority_group, rule_definition, defining_characteristics, marketing_objective))"


def _rationale_sql(p: str = "p") -> str:
    q3 = "'''"
    return (f"format('{{:,}}', {p}.n_customers) || ' customers (' || printf('%.2f', {p}.pct_of_base) || '% of base) with a ' "
            f"|| printf('%.1f', {p}.churn_rate_pct) || '% actual churn rate and ' || format('{{:,.0f}}', {p}.total_HRR) "
            f"|| ' NT$ in Historical Realized Revenue among them (median ' || format('{{:,.0f}}', {p}.median_HRR) "
            f"|| ' NT$/customer). ' || printf('%.0f', {p}.pct_matching_dominant_recommendation) "
            f"|| '% of this group falls into the {q3[:2]}' || {p}.dominant_risk_value_recommendation "
            f"|| '{q3[:2]} cell of the risk x value framework, "
            f"which sets the recommended intensity below.'")


PLAN_FULL_SQL = PLAN_SQL.replace("\n, base AS", ",\nbase AS", 1) + f"""
SELECT p.priority_group, p.priority_group_order, t.rule_definition, p.n_customers, p.pct_of_base, p.churn_rate_pct,
       p.total_HRR, p.median_HRR, t.defining_characteristics, t.marketing_objective, p.intervention_intensity,
       p.dominant_risk_value_recommendation, p.pct_matching_dominant_recommendation,
       CASE WHEN p.n_customers > 0 THEN {_rationale_sql()} END AS rationale
FROM plan p LEFT JOIN {_texts_sql()} t ON t.priority_group = p.priority_group"""


@register("marketing_action_plan", sql_final(qc(PLAN_FULL_SQL), ["pct_of_base", "churn_rate_pct", "total_HRR", "median_HRR",
                                                                 "pct_matching_dominant_recommendation"]))
def marketing_action_plan(spark, sf):
    """D19 + B20 + B33: the 13-column marketing action plan (texts from a fixed
    seven-row dimension joined by broadcast, rationale templated per row)."""
    return finalize(SG.action_plan_full(Chain.shared(spark, sf).customer_actions()))
