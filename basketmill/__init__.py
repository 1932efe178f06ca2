"""Purchase-log recommendation analytics, written as PySpark DataFrame jobs."""
