"""Versioned key-value analytics on Spark: mutation logs, sorted runs, levels and lookups."""
