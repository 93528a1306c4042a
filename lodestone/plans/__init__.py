"""Query catalogue and plan helpers."""
