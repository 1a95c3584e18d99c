"""Operators for preparing large text corpora, and the queries built on them.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the folder is present.
"""
