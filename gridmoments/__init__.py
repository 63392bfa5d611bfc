"""gridmoments: gridded-simulation analytics expressed as Spark DataFrame operations."""
