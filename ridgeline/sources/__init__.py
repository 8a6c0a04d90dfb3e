"""Tables in and out, and intermediate tables."""
