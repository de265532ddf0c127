"""Operators that prepare text collections for model training.

Nothing outside this package imports it; it may be removed with its tests.
"""
