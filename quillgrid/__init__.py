"""Spark-native analytics over unbounded two-dimensional grids."""
