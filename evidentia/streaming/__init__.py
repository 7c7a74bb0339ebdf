"""Scans and lookups on streams."""
