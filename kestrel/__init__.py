"""Kestrel: lookalike-domain analytics on Spark DataFrames."""
