"""Operators for large training-data corpora: archives, scoring, packing, duplicates, sharding."""
