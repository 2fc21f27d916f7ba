"""millrace: a Spark-native code retrieval, graph and corpus engine."""

__version__ = "0.1.0"
