"""Behavioural-similarity analytics on Spark DataFrames."""
