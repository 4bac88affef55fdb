"""Labelled-graph pattern analytics on Spark DataFrames."""
