"""Nonlinear system identification and time-series analytics on Spark DataFrames."""
