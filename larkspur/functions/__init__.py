"""Values and built-in functions of the query language."""
