"""Operators on grids: rows (i, j, v), optionally with a channel or tensor id."""
