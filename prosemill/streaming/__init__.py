"""Structured Streaming forms of the corpus stages."""
