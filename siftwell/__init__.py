"""PySpark-native audit engine for captured pages, and corpus operators for training data."""
