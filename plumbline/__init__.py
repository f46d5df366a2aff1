"""A PySpark-native engine for review integrity."""
