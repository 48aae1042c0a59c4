"""lexmill.streaming."""
