"""Operators for preparing text corpora for language-model training.

Nothing else in the library imports this subpackage; it may be deleted as a
whole.  Each module holds one operator, ``queries`` registers the thin queries
over the standard tables and ``oracles`` their DuckDB equivalents.
"""
