"""Seine: a Spark-native engine for entity search, extraction, resolution and ranking."""

__version__ = "0.1.0"
