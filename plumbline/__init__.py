"""Data-quality engine on Spark: profile, check, score, correct and track tables."""

__version__ = "0.1.0"
