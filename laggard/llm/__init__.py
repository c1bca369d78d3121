"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it.  Each operator is a function from
DataFrame to DataFrame; ``queries`` applies them to the given tables.
"""
