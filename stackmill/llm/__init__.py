"""Operators for preparing training data: matching, merging, deduplication, text form, packing, mixing, quality.

Nothing outside this subpackage imports it.
"""
