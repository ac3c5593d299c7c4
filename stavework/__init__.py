"""Preparing and checking corpora of symbolic music with Spark DataFrames."""
