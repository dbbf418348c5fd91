"""corpuscle: a Spark-first engine for retrieval and preparation of semi-structured documents."""

__version__ = "0.1.0"
