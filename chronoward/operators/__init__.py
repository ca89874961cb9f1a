"""Relational operators over irregular time series; each takes and returns DataFrames and stays lazy."""
