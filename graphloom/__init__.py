"""Spark-native knowledge-graph analytics: every operator is a DataFrame plan."""
