"""Operators on panels: plain functions from DataFrames to DataFrames."""
