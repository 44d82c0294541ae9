"""Training-data operators: deduplication, mixing, packing, scoring, sharding and formatting of documents.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
