"""Training-data operators: near-duplicate search, sharding, scoring, extraction, tokenising.

Nothing outside this subpackage imports it.
"""
