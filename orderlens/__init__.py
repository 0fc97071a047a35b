"""orderlens: commerce analytics as PySpark DataFrame jobs."""
