"""A PySpark-native engine for log and security-event analytics."""
