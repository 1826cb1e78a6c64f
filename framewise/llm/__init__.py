"""Training-data operators: deduplication, search, sanitising, mixing, tokenising and archives.

Nothing outside this subpackage imports it.
"""
