"""lodestat: Spark-native regression analytics over interval-joined event data."""

__version__ = "0.1.0"
