"""Ravelin: content-security scanning of text and code packages as Spark DataFrame queries."""

__version__ = "0.1.0"
