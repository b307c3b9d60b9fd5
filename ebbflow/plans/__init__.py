"""End-to-end plans: the scoring-to-action chain and the query catalog."""
