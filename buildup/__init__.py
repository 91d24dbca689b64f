"""Possession-sequence analytics on Spark DataFrames."""
