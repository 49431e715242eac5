"""Operators for large text corpora: cleaning, deduplication, mixing, packing and storage."""
