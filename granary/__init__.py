"""Spark-native preparation, packing and auditing of text and vector datasets."""
