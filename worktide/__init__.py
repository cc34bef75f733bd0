"""Working-time and agreement analytics as Spark DataFrame and streaming jobs."""
