"""Training-data operators: dedup, tokenisation, packing, sharding, quality and search."""
