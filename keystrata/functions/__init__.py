"""Scalar functions: byte codecs, checksums and record layout."""
