"""Column-level helpers; every one is a composition of built-in functions."""
