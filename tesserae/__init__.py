"""A Spark-native engine for source, text and graph analytics."""
