"""Zero-configuration predictive analytics over Spark tables."""

__version__ = "0.1.0"
