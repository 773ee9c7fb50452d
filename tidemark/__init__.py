"""Point-in-time features and score evaluation on Spark DataFrames."""

__version__ = "0.1.0"
