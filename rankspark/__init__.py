"""rankspark: search-ranking and retrieval data preparation as Spark DataFrame jobs."""
