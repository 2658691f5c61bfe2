"""A Spark-native likelihood-ratio analytics engine."""
