"""Training-data operators: sharding, mixing, filtering, near-duplicates, tokens.

Nothing else in the library imports this subpackage.
"""
