"""Training-data operators: quality, safety, deduplication and encoding of text corpora.

Nothing else in the package imports this subpackage.
"""
