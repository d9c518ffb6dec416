"""Queries over the test tables, composed of the operators, with their SQL."""
