"""Operators for large training-text corpora: filtering, deduplication, mixing, sharding and search."""
