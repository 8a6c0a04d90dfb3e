"""Ridgeline: analytics and data preparation on PySpark DataFrames."""
