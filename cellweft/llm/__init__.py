"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries and their SQL live in ``queries``.
"""
