"""Operators for preparing training corpora: tokenising, cleaning, deduplication,
classification, sharding and vector search."""
