"""Name and entity matching as Spark DataFrame jobs."""
