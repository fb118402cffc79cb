"""Quarry: analytics over source-code and document corpora as PySpark plans."""
