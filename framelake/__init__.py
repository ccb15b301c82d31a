"""Frame-series analytics on Spark."""
