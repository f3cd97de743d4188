"""Training-data operators: packing, dedup, filters, fingerprints, tokenizers, media columns."""
