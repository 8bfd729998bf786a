"""Operators of the source-corpus engine."""
