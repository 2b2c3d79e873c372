"""lodeweave: a Spark-native engine for document retrieval, ingestion and declarative metrics."""
