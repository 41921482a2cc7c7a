"""Operators of a training-data pipeline: filters, fingerprints, deduplication, classifiers and tokenizers over documents."""
