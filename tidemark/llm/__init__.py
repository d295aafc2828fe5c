"""Operators for large text corpora: deduplication, filtering, privacy, packing and file formats.

Nothing outside this subpackage imports it.
"""
