"""docloom: document analytics and retrieval written as Spark DataFrame jobs."""

__version__ = "0.1.0"
