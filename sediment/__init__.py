"""sediment: a Spark-native analytics engine with embedded-database semantics."""

__version__ = "0.1.0"
