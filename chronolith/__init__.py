"""Content-addressed history and corpus analytics on PySpark."""
