"""Spark-native cleaning, structuring and assembly of long-form text."""
