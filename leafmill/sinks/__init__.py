"""Sinks: files beside documents, and keyed tables."""
