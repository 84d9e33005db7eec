"""Log anomaly detection expressed as Spark DataFrame jobs."""
