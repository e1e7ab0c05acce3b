"""Syntax trees to DataFrames and Columns."""
