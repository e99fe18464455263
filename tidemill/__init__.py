"""News-intelligence analytics on PySpark."""
