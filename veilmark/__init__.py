"""Spark-native detection, replacement and measurement of personal data in text."""
