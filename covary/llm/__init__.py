"""Operators for preparing large text corpora: filters, deduplication, decontamination, tokens, scores."""
