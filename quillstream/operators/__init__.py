"""Quillstream operators."""
