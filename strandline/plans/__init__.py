"""Plan-level helpers shared by all operators."""
