"""Operators that prepare text for training language models.

Nothing else in the library imports this package; the queries that use it are
registered only where it can be imported.
"""
