"""Level-of-detail graph analytics on Spark."""
