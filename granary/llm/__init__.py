"""Operators for preparing training data: cleaning, deduplication, counting, packing, mixing and search."""
