"""Quillstream functions."""
