"""locusmill: a PySpark-native engine for place analytics and text-corpus preparation."""

__version__ = "0.1.0"
