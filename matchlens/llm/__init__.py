"""Training-data operators: one module per operator, plus the queries that apply them.

Nothing else in the library imports this subpackage.
"""
