"""Streaming of the source-corpus engine."""
