"""Ordered numeric series on DataFrames: maps, reductions and positional sliding windows as Catalyst plans."""

from tidemark.operators.series import Series

__all__ = ["Series"]
