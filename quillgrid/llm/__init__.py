"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` in
:mod:`quillgrid.llm.registry` are what the driver entry point picks up.
"""
