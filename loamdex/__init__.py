"""A PySpark-native toolkit for building and querying a small web index."""
