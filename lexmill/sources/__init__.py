"""lexmill.sources."""
