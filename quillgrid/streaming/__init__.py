"""Structured Streaming forms of the operators that are kept up to date from a stream of cells."""
