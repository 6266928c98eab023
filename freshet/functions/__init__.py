"""Column-level helpers: calendar rules and scalar math."""
