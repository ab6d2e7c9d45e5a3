"""Spark-native analysis of network-flow records."""
