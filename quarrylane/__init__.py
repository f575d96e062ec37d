"""Spark-native building blocks for ranked-candidate corpora over business text."""
