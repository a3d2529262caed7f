"""Column builders: parsing, rating policies, keys, deterministic picks, small statistics."""
