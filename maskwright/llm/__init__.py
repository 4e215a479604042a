"""Operators of a training-data pipeline: ``queries`` registers one query per operator.

Nothing else in the library imports this subpackage.
"""
