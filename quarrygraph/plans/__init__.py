"""Composed plans: the index build and the registered queries."""
