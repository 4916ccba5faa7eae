"""Catalog change tracking, expansion, export and task statistics on Spark."""

__version__ = "0.1.0"
