"""Property graphs from semi-structured sources, as PySpark DataFrame jobs."""
