"""Quillstream: news and item-stream analytics as DataFrame pipelines."""
