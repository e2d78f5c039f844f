"""Operators of a large training-data pipeline, and their registered queries.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when the folder is there.
"""
