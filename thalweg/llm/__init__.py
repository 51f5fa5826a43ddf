"""Training-data operators: deduplication, scans, packing, tokenization, scoring and search.

Nothing outside this subpackage imports it.
"""
