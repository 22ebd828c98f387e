"""Sedge: a document query engine that lowers document-style commands to Spark plans."""

__version__ = "0.1.0"
