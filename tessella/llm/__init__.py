"""Training-data operators: quality, dedup, scoring, tokenising, extraction, archives, safety."""
