"""Imports every query module so their ``@register`` calls run."""

from ebbflow.plans import q_calibration, q_extra, q_features, q_misc, q_ml, q_plan, q_profile, q_scoring, q_segments, q_serving, q_states  # noqa: F401
