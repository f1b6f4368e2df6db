"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; `queries.py` holds the thin registered queries.
"""
