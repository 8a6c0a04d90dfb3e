"""Queries over the tables, each with its SQL."""
