"""Operators for large training corpora: tokens, mixing, language, packing, search, quality, duplicates, shards, WARC."""
