"""Structured Streaming shells around the batch operators."""
