"""Market analytics and dataset profiling, written as PySpark DataFrame jobs."""
