"""Operators of a training-data pipeline over ``documents`` (doc_id, text, ...).

Nothing else in the package imports this folder; ``queries.py`` holds the
registered queries and their SQL.
"""
