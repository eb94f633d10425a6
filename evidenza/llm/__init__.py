"""Training-data operators: deduplication, mixing, filtering, sharding, packing, search and media.

Nothing else in the library imports this subpackage.
"""
