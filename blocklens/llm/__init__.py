"""Training-data operators: extraction, filtering, deduplication, mixing, tokenising and scoring of text tables."""
