"""A PySpark-native engine for spatial queries and corpus processing."""
