"""Loaders, scans and sinks."""
