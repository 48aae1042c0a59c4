"""lexmill.operators."""
