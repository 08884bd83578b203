"""Cluster-center discovery and corpus processing on Spark DataFrames."""
