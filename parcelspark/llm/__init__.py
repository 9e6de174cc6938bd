"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module holds one operator; the
thin contract queries are in ``queries.py``.
"""
