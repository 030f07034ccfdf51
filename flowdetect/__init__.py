"""Spark-native network-flow threat analytics: DataFrame in, DataFrame out."""
