"""stratamap: a Spark-native engine for block-structured map extracts and the tables around them."""

__version__ = "0.1.0"
