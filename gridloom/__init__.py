"""Labelled, multi-dimensional scientific data as Spark DataFrames: a row for each time and cell, a column for each item."""

from gridloom.frame import Frame
from gridloom.items import Item

__all__ = ["Frame", "Item"]
