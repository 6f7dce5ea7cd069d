"""Operators over DataFrames: joins, aggregates, windows, recursion, changes of tables."""
