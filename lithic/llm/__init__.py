"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Operators take and
return DataFrames; each one's docstring states its results for nulls, empty
and very long texts, ties, repeated rows, empty tables and clashing columns.
"""
