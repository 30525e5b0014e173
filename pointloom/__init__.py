"""Spark jobs over tables of points: filters, joins, statistics, ordered series, resampling and comparison of curves."""
