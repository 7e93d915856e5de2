"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; it can be deleted without
touching the rest.  Each module holds one operator; ``registry`` holds the
queries and their SQL.
"""
