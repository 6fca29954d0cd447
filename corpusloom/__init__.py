"""Corpus construction and measurement operators on Spark DataFrames."""
