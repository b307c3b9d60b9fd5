"""Column-expression helpers: every rule is a Catalyst expression (no Python UDF)."""

from ebbflow.functions.expr import *  # noqa: F401,F403
