"""Column functions: all of them Catalyst expressions."""
