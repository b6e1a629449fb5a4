"""Community signal analytics as Spark DataFrame jobs."""
