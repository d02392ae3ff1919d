"""Event-log analytics on PySpark DataFrames."""
