"""Operators for training corpora: search, quality, privacy, packing, deduplication, extraction and mixing."""
