"""Quern: an analytics engine made of Spark DataFrames and Spark SQL."""
