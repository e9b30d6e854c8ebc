"""Operators for large text corpora: packing, deduplication, similarity joins, search, mixing, classification, token files.

Nothing else in the library imports this subpackage; ``catalog`` holds its queries over the driver tables.
"""
