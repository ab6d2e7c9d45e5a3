"""Incremental scoring of flow files as they arrive."""
