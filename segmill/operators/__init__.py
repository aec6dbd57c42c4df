"""Operators: functions from DataFrames to DataFrames. Clocks are parameters (as_of)."""
