"""Operators on tables of points: selection, joins, statistics, ordered series, resampling, comparison."""
