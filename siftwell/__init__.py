"""PySpark-native analytics engine for text retrieval data."""
