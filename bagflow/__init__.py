"""Lazy partitioned multisets on Spark."""
