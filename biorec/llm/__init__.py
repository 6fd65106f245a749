"""Operators for preparing language-model training corpora.

Thirteen operators over document, page and embedding tables, each a function from
DataFrames to DataFrames. Nothing outside this package imports it.
"""
