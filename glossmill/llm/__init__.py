"""Operators of a training-data pipeline: cleaning, deduplication, scoring and mixing.

Nothing outside this folder imports it.  ``queries.py`` holds the thin queries
that apply each operator to its table.
"""
