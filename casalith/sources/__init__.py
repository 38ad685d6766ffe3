"""Readers: files, delimited and JSON tables, HTML and JSON extraction, registries."""
