"""Event-log analytics and data preparation on PySpark DataFrames."""
