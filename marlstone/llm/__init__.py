"""Training-data operators: filters, deduplication, mixing, scoring, sharding, formatting."""
