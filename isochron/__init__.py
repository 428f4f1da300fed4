"""Time-series analytics on PySpark: operators, sources, functions, plans and streaming over readings."""
