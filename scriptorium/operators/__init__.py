"""Operators: functions from DataFrames to DataFrames, one row per fact, keyed by ``ms_id``."""
