"""Training-data operators: deduplication, tokenization, archives, search, scoring, packing, formatting."""
