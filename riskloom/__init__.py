"""Spark-native decision analytics: composable DataFrame operators over application, score and label tables."""
