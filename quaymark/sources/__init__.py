"""Readers: parquet tables, task documents, raw delimited rows."""
