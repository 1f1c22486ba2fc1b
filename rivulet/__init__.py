"""A PySpark-native basin analytics engine."""
