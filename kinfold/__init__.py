"""Genealogy and interval analytics on Spark DataFrames."""
