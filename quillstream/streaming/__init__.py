"""Structured Streaming forms of the item and state operators."""
