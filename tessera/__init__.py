"""tessera: conversational-memory retrieval on PySpark DataFrames."""

__version__ = "0.1.0"
