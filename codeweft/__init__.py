"""codeweft: code property graphs and corpus preparation on PySpark."""

__version__ = "0.1.0"
