"""Spark-native analysis of source files and text corpora."""
