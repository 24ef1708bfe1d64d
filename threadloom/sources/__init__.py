"""Readers, writers and incremental append."""
