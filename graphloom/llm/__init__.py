"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module documents how it treats nulls, empty and
very long texts, ties, repeated rows, empty tables and extra columns.
"""
