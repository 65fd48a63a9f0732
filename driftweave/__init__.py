"""Drift-aware stream clustering and vector analytics on Spark DataFrames."""
