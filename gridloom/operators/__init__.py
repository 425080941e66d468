"""Operators on tables of time and cells; all are lazy plans."""
