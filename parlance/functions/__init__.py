"""Column builders: native expressions only."""
