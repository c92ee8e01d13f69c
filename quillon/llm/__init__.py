"""Training-data operators: tokenising, deduplication, scans, scoring, packing, sharding.

Nothing outside this subpackage imports it.
"""
