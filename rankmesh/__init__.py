"""Relational collectives and distributed array operators for Spark DataFrames."""
