"""Training-data operators: deduplication, sharding, scoring, mixing, encoding, filtering, formatting.

Nothing outside this subpackage imports it.
"""
