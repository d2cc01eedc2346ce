"""Hiring-analytics operators on PySpark DataFrames."""
