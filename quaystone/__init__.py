"""Market-data and factor jobs on Spark."""
