"""Evidence retrieval and data profiling on Spark DataFrames."""

__version__ = "0.2.0"
