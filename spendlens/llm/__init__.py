"""Operators of a training-data pipeline: extraction, classification, tokens,
near duplicates, search, chat formatting, scoring, decontamination.

Nothing else in the library imports this package.  Each operator lives in its
own module and has a general interface; ``queries`` binds them to the shared
tables and derives the digest columns.
"""
