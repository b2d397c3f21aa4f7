"""A PySpark-native engine for nested, time-based records and training corpora."""
