"""Text-to-vector analytics on Spark: tokenize, embed, store, search and evaluate with DataFrames."""

__version__ = "0.1.0"
