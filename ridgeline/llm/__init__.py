"""Training-data operators: deduplication, tokenization, sharding, filtering, mixing and search."""
