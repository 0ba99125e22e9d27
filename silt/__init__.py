"""silt: log analytics on Spark."""
