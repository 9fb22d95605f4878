"""Cadenza: time-series, interval, vector and feedback analytics on PySpark DataFrames."""
