"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; :mod:`sparklex.llm.registry` binds them to the standard
tables.
"""
