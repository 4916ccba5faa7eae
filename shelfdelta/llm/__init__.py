"""Operators for training-data pipelines: archives, packing, fingerprints, tokens, quality, duplicates, language, URLs."""
