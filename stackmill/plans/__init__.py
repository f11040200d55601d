"""Derived views, named queries and plan helpers."""
