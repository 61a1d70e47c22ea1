"""A Spark-native engine for security-relevant findings in source text."""
