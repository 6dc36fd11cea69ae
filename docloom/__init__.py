"""docloom: a Spark-first engine for analysing collections of procedure documents."""

__version__ = "0.1.0"
