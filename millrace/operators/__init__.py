"""Relational and record operators built on the DataFrame API."""
