"""Explainable fuzzy-rule analytics on Spark DataFrames."""
