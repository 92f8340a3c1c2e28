"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
names of columns, looks only at the columns it names (extra columns, whatever they
are called, are ignored or passed through untouched) and states in its docstring
what nulls, empty texts, ties and repeated rows give.
"""
