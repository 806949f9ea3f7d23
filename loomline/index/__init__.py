"""Persisted indices: immutable segments under one pointer file, of text and of vectors."""
