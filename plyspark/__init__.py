"""PlySpark: board-game corpora as Spark tables."""
