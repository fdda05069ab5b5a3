"""graphloom: a document-and-graph query engine whose plans are ordinary Spark DataFrames."""

__version__ = "0.1.0"
