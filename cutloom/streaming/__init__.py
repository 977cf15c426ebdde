"""Structured Streaming forms of the speech operators."""
