"""sheaf: a Spark engine that turns collections of documents into analysis-ready tables."""

__version__ = "0.1.0"
