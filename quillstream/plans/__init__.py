"""Quillstream plans."""
