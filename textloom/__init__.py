"""Textloom: analytics over versioned text corpora, declared as Spark plans."""

__version__ = "0.1.0"
