"""Operators for language-model training data. Nothing else in the library imports this package.

Every operator takes and returns DataFrames, keeps the caller's columns, reads whole texts and
treats a null text as empty. Columns an operator adds never overwrite a caller's column: where a
name is taken, :func:`common.free_name` picks another for internal work.
"""
