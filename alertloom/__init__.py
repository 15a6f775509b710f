"""A PySpark-native engine for security-alert analytics."""
