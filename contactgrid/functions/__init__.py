"""Column-level building blocks. All of them compile to built-in Catalyst expressions."""
