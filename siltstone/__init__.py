"""A PySpark-native engine for evidence analytics."""
