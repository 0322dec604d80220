"""Analytics for retrieval corpora and conversation feedback on Spark."""
