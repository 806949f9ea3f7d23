"""Loomline: conversational-text and retrieval analytics as lazy PySpark plans."""

__version__ = "0.1.0"
