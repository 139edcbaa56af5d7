"""Column expressions: everything here is Column in, Column out."""
