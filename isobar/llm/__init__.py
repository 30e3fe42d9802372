"""Training-data operators: dedup, archive, formatting, tokens, quality, PII, mixing, media, search."""
