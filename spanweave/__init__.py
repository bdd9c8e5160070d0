"""Spanweave: standoff-annotation analytics as ordinary Spark plans."""

__version__ = "0.1.0"
