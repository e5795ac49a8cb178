"""Corpus preparation for language models: packing, archives, near-duplicates, extraction, scoring, filters."""
