"""Whole-dataset pipelines."""
