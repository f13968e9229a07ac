"""Streaming ingest into a store."""
