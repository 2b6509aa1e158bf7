"""A PySpark-native engine for multi-source entity resolution."""
