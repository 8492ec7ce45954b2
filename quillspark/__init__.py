"""A Spark-native search-and-archive engine."""
