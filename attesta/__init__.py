"""Spark-native verification of structured question-and-answer content."""
