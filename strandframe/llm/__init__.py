"""Operators for preparing training text: tokens, packing, deduplication, filters and classifiers."""
