"""Training-data operators: text, dedup, scoring, mixing, sharding and search."""
