"""Spark-native analytics over symbol sequences, annotated intervals and text corpora."""
