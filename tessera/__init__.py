"""A Spark-first knowledge-graph and text analytics engine."""

__version__ = "0.1.0"
