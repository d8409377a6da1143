"""Readers, writers and generators of arrays."""
