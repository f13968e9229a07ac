"""Relational operators over mutation logs, sorted runs and manifests."""
