"""Origin-destination trip analytics on PySpark."""
