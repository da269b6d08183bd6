"""Spark-native content analytics: DataFrame in, DataFrame out."""
