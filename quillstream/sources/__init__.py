"""Quillstream sources."""
