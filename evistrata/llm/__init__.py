"""Operators for large text corpora: encoding, deduplication, mixing, scanning."""
