"""Resight: Spark-native analytics for temporal re-identification and corpus preparation."""
