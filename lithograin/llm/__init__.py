"""Training-data operators: deduplication, quality, PII, tokenising, mixing and sharding.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library intact.
"""
