"""Training-data operators: dedup, packing, sharding, cleaning and scoring of text corpora.

Nothing else in the library imports this subpackage.
"""
