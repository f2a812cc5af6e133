"""Multibeam sonar analytics on Spark DataFrames."""
