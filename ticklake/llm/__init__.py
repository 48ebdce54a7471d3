"""Training-data operators: sharding, deduplication, extraction, scoring, tokenizing."""
