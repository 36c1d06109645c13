"""Training-data operators: search, near-duplicates, sharding, media, tokens, HTML, mixing, licences, PII, languages."""
