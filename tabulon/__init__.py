"""Typed-decision analytics and training-data preparation on PySpark DataFrames."""
