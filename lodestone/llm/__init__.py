"""Training-data operators: mixing, filtering, deduplication, scoring and tokenising whole corpora."""
