"""Catalogue integration and analytics on Spark DataFrames."""
