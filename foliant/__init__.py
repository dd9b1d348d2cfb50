"""A document-layout analytics engine on PySpark DataFrames."""
