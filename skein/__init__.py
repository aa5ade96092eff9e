"""Feed and web-content analytics on Spark DataFrames."""

__version__ = "0.1.0"
