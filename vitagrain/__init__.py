"""Profile, posting and activity analytics expressed as Spark DataFrame jobs."""
