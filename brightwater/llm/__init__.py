"""Operators for large training-data pipelines, written for Spark.

Every operator is a function from DataFrames to a DataFrame with its own interface; ``queries``
holds the thin registered queries that apply each to its whole table. Nothing else in the library
imports this subpackage.
"""
