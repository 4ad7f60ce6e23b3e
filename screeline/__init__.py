"""Spark-native analytics over tracks, routes, votes and texts.

Operators are functions from DataFrame to DataFrame with the column names as
parameters.  Nothing here imports the subpackage ``llm``; that subpackage may be
deleted without touching the rest.
"""

__version__ = "0.1.0"
