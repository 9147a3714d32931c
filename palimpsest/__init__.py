"""Versioned, hierarchical document tables on Spark."""
