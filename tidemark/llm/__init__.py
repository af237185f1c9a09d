"""Operators for preparing training data: deduplication, scoring, counting, mixing and packing of documents."""
