"""Training-data operators: tokenizers, near-duplicates, scans, search, packing."""
