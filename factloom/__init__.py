"""Evidence verification and training-data preparation as Spark DataFrame operations."""

__version__ = "0.1.0"
