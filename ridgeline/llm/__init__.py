"""Operators for preparing language-model training data.

Each module holds one operator.  ``registry`` holds the queries built on them
and their SQL.
"""
