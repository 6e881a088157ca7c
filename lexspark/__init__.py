"""Structured-document analytics on Spark DataFrames."""
