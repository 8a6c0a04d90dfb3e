"""Operators that Spark has no single call for."""
