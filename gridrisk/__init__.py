"""gridrisk: panel risk analytics on Spark DataFrames, SQL and MLlib."""

__version__ = "0.1.0"
