"""Spark-native building and scoring of evaluation and training data."""
