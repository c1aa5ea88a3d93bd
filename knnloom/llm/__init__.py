"""Operators of a training-data pipeline over a documents table.

Nothing outside this subpackage imports it.  ``knnloom.llm.queries`` holds the
registered queries and their SQL.
"""
