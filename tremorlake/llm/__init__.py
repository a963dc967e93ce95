"""Operators for training-data pipelines: text quality, deduplication, packing, archives.

Nothing outside this subpackage imports it.
"""
