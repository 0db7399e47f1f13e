"""Operators for preparing language-model training data, one module each.

Nothing outside this package imports it; `registry` lists its queries and SQL.
"""
