"""Readers for delimited text, JSON, Parquet, workbooks and inline rows."""
