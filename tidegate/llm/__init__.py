"""Training-data operators: tokens, sharding, decontamination, deduplication, filters and packing."""
