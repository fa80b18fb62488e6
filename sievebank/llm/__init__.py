"""Operators for large-scale training-data pipelines.

Nothing else in ``sievebank`` imports this subpackage.  Every operator takes and
returns DataFrames; ``registry`` holds the queries that the driver runs.
"""
