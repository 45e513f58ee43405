"""Sources that Spark has no reader for."""
