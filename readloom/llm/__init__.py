"""Training-data operators: scoring, mixing, deduplication, packing, search."""
