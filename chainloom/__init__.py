"""Chainloom: Spark-native tables from a reorganising block stream, and training-data operators."""
