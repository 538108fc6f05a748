"""Training-data operators: filtering, deduplication, packing, tokenising and search."""
