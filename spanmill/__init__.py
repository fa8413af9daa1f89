"""Interval analytics for insertion/deletion calls, on Spark DataFrames."""
