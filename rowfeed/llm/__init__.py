"""Training-data operators: tokens, deduplication, quality, safety, packing and output."""
