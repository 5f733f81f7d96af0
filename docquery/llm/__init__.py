"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, works on whole texts and whole tables, and gives a defined result
for null, empty and repeated rows (see each module's docstring).
"""
