"""Operators for preparing large text corpora: deduplication, filtering, sharding, packing and tokenising.

Nothing outside this package imports it.
"""
