"""Relational operators on corpora: deduplication and retention."""
