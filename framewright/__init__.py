"""Media-embedding analytics and training-data operators, built on PySpark DataFrames."""

__version__ = "0.1.0"
