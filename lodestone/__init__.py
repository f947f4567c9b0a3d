"""Lodestone: full-text search and text-data processing expressed as PySpark plans."""
