"""Training-data operators: filters, deduplication, mixing, sharding and token output.

Nothing outside this subpackage imports it.
"""
