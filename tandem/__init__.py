"""With / without impact analytics and corpus operators as PySpark DataFrame jobs."""
