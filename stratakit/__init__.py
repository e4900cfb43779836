"""Feature encoding, statistics, clustering, layers and signals as Spark DataFrame operations."""
