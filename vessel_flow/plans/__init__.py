"""Composed plans: the whole pipeline and the registered queries."""
