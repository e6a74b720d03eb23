"""Training-data operators: sharding, deduplication, mixing, scoring, archives, packing, search."""
