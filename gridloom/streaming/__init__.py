"""Incremental variants for data that arrives over time."""
