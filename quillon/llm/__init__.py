"""Training-data operators: fingerprints, deduplication, scoring, mixing and packing.

Nothing outside this subpackage imports it.
"""
