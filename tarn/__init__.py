"""A Spark-native engine for document retrieval, table analytics and corpus work."""

__version__ = "0.1.0"
