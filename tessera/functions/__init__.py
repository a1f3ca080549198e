"""Scalar functions and operators of the query language, as column expressions."""
