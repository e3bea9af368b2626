"""Operators for building training corpora: tokenising, media, sharding, deduplication, packing, language and quality models."""
