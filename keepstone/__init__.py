"""Keepstone: memory analytics and retrieval expressed with Spark DataFrames."""

__version__ = "0.1.0"
