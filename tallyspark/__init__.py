"""Tabular document, costing and catalogue analytics on Spark DataFrames."""
