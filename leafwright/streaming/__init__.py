"""Structured Streaming forms of the progress and cache operators."""
