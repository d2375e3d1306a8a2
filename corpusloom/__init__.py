"""A PySpark-native engine for text corpora."""
