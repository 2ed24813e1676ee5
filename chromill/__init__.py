"""Colour and text analytics over Spark DataFrames."""
