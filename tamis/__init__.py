"""tamis: indicator extraction and reputation-list building as Spark DataFrame plans."""

__version__ = "0.1.0"
