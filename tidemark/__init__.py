"""Versioned key/time analytics on PySpark: operation logs, runs, lookups, compaction and metrics."""
