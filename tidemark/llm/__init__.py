"""Operators for preparing training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface and the thin query that applies it to a
whole table; ``queries`` gathers them.
"""
