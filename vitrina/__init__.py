"""Product-offer analytics on Spark."""
