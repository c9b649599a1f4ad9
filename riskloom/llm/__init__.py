"""Operators of a training-data pipeline over text corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
