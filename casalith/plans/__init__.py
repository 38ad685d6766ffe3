"""Whole queries: compositions of operators over the supplied tables."""
