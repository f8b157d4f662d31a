"""Operators for preparing large text corpora for language-model training.

Every module holds one operator with a general interface (any DataFrame, any
column names); ``queries`` wraps them into the registered queries.
"""
