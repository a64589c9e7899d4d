"""Readers, writers and text renderings."""
