"""Document privacy and relationship analytics on Spark."""
