"""Catalogue analytics and feed processing on PySpark DataFrames."""
