"""tripscope: trip-operations metrics, movements and attribution as Spark DataFrame jobs."""
