"""spanforge: a Spark-native engine for interval, alignment, variant and block-compressed record data."""

__version__ = "0.1.0"
