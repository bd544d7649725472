"""Transcript cost analytics on Spark DataFrames."""
