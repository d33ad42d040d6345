"""Find themes in large collections of articles with PySpark."""
