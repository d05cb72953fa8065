"""Training-data operators: deduplication, packing, extraction, scoring, mixing, search.

Nothing outside this package imports it.
"""
