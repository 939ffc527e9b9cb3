"""Similarity-network analytics on Spark: long keyed tables in, long keyed tables out."""
