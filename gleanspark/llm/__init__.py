"""Operators of a training-data pipeline: tokens, page text, packing, classifiers, duplicates, fingerprints, languages."""
