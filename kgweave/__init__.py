"""kgweave: a Spark-native engine that turns document collections into queryable knowledge graphs."""

__version__ = "0.1.0"
