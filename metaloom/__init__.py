"""Catalog, lineage and privacy analytics for data estates, as Spark DataFrames."""

__version__ = "0.1.0"
