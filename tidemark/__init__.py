"""Tidemark: change streams, derived tables and analytics on Spark."""
