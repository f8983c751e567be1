"""Tracewell: program-graph and test-evidence analytics on Spark DataFrames."""
