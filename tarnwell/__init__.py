"""Tarnwell: a PySpark-native analytics engine for code graphs, operation ledgers, logs and project texts."""

__version__ = "0.1.0"
