"""quarrykit: retrieval, text and evaluation analytics as Spark DataFrame jobs."""
