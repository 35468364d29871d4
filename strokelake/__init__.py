"""Metafile analytics and columnar operators expressed as Spark DataFrames."""
