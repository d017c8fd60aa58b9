"""Flood-impact analytics as Spark DataFrame jobs over many scenario runs at once."""

__version__ = "0.1.0"
