"""Energy and greenhouse-gas accounting on Spark DataFrames."""

__version__ = "0.1.0"
