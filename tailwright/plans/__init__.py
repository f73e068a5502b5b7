"""Whole plans: the bridge tables, the registered queries, and the end-to-end pipeline."""
