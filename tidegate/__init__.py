"""Flow-security analytics expressed as Spark DataFrame, ML and streaming plans."""

__version__ = "0.1.0"
