"""Species-occurrence analytics as Spark DataFrame jobs."""
