"""Flow analytics as PySpark table and stream operators."""

__version__ = "0.1.0"
