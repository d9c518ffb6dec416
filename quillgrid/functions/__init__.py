"""Scalar and tile functions."""
