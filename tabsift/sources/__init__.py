"""Readers of landed files, inline tables, and the registry of data sources."""
