"""Training-data operators: search, counting, filtering, deduplication, mixing, sharding and encoding."""
