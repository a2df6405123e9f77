"""foliant: a Spark-native engine for structured analysis of long documents."""

__version__ = "0.1.0"
