"""Operators of a training-data pipeline over tables of documents and pages.

Nothing else in the package imports this subpackage. Texts are read whole; every operator
says in its docstring what it returns for nulls, empty tables, ties and repeated rows.
"""
