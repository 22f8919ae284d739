"""Structured Streaming wrappers of the stateful operators."""
