"""lexmill.functions."""
