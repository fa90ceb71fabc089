"""Concept, taxonomy and corpus jobs on Spark DataFrames."""
