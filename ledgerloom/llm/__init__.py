"""Training-data operators: near duplicates, quality, search, shards, languages, licences, urls, tokens, packing."""
