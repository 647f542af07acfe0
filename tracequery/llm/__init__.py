"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator lives in
its own module with a general interface; ``queries`` holds the thin queries
that derive digest columns from the operators' outputs.
"""
