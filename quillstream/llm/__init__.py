"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; the registered queries are in ``quillstream.llm.queries``.
"""
