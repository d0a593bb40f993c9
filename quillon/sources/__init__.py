"""Versioned tables and the commit log."""
