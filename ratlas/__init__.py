"""Ratlas: council records and training-data pipelines as Spark plans."""

__version__ = "0.1.0"
