"""graftline: a PySpark-native engine for lineage analytics over operator graphs."""

__version__ = "0.1.0"
