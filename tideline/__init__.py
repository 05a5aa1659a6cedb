"""Tideline: irregular time-series observations on Spark DataFrames."""
