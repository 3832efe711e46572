"""Vehicle-fleet and after-sales analytics as Spark DataFrame, SQL, MLlib and streaming jobs."""
