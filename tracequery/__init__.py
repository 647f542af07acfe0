"""Signal-trace analytics on Spark."""
