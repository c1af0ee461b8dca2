"""A PySpark-native engine: secondary indexes, per-file statistics and caching for Spark SQL tables."""

__version__ = "0.1.0"
