"""Relational operators over the evidence model."""
