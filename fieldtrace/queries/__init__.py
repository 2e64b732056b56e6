"""Registered queries: callables on (spark, sf_dir) and their SQL."""
