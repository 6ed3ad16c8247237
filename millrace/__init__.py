"""millrace: a Spark-native engine for declarative data pipelines."""

__version__ = "0.1.0"
