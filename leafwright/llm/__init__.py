"""Training-data operators: filters, near-duplicates, tokenizers, mixing, archives and media columns."""
