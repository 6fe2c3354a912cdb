"""Brightmill: a PySpark-native analytics engine for service logs, conversations and web pages."""
