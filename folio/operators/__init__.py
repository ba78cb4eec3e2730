"""Operators: functions from DataFrames to DataFrames. Rankings carry an explicit total order."""
