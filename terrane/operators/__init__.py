"""Analytic operators: long DataFrames in, long DataFrames out, nothing collected unless a docstring says so."""
