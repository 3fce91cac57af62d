"""Operators for spatio-temporal entity state and change, on Spark DataFrames and Structured Streaming."""
