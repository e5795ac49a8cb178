"""Column functions: patterns, span extraction, validators, normalisation and replacement values."""
