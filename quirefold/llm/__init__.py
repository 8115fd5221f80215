"""Operators of a training-data pipeline over document, conversation and vector tables.

Nothing else in the library imports this subpackage. Every module holds one operator
with its general interface; ``queries`` registers one thin query for each.
"""
