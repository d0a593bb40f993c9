"""Relational and vector operators as DataFrame transformations."""
