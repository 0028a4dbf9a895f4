"""Document-intake analytics on Spark."""
