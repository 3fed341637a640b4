"""Analytics of code-switched transcripts on Spark."""
