"""Registered queries: operators composed over the parquet tables."""
