"""lexmill.plans."""
