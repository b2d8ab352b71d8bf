"""coppice: a PySpark-native engine for analytics over trees, graphs, sets and texts."""

__version__ = "0.1.0"
