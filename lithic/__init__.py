"""Typed, strictly checked Parquet records on Spark."""
