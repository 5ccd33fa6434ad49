"""millrace: a PySpark-native engine for files, findings, charts and text."""

__version__ = "0.1.0"
