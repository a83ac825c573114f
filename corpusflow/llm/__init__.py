"""Operators for large-scale training-data pipelines.

One module per operator; ``queries`` binds them to the tables of a data
directory.  Nothing else in the library imports this package.
"""
