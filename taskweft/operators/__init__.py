"""Operators: functions from DataFrames to DataFrames, without session or state of their own."""
