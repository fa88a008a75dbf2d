"""Spark-native analysis of captured script and page assets."""
