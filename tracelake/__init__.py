"""Sampled-array analytics on Spark: cubes as DataFrames, operators as plans."""
