"""Training-data operators: privacy, deduplication, quality, sharding and tokenisation.

Nothing else in the library imports this package.
"""
