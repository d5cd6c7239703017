"""Spark-native code and corpus analytics."""
