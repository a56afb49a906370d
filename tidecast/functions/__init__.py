"""Column-expression builders (no Python UDFs): special functions and distributions."""
