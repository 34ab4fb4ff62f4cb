"""Training-data operators: deduplication, tokenising, mixing, language ID and sharding.

Nothing outside this subpackage imports it.
"""
