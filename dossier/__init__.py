"""Document-intelligence analytics on PySpark DataFrames."""
