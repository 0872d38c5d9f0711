"""A document-processing engine on PySpark DataFrames."""
