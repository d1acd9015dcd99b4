"""Operators over quad DataFrames."""
