"""A PySpark-native engine for versioned text memories, their analytics and retrieval."""

__version__ = "0.1.0"
