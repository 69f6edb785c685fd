"""Sieveworks: dataset curation and evaluation auditing on PySpark DataFrames."""

__version__ = "0.1.0"
