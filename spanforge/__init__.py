"""spanforge: a PySpark-native engine for coding-agent session traces."""

__version__ = "0.1.0"
