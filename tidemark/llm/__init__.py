"""Operators for preparing training text and vectors at scale.

Nothing outside this package imports it.  ``queries.py`` registers one query
per operator and holds the SQL that checks them.
"""
