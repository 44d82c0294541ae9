"""A PySpark-native engine for quantities in large text corpora."""
