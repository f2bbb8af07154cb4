"""Relational, change-stream, key-value, queue and observability operators."""
