"""Wavelark: time-series window analytics on PySpark DataFrames."""
