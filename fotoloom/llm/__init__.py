"""Training-data operators: dedup, mixing, decontamination, search, tokens."""
