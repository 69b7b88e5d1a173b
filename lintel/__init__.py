"""A PySpark-native engine for code analysis over tables."""
