"""A PySpark-native engine for text classification and corpus analysis."""
