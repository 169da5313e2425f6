"""nearmatch: near-duplicate analytics on PySpark."""
