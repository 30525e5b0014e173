"""Scalar functions on columns and arrays, and special functions."""
