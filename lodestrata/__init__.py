"""lodestrata: a PySpark-native engine for evidence, knowledge graphs and corpus processing."""

__version__ = "0.1.0"
