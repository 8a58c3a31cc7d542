"""Quillon: knowledge-graph reasoning analytics and benchmark building on Spark DataFrames."""
