"""Granary: document-evidence analytics and corpus preparation on Spark DataFrames."""
