"""Column functions: vectors, metadata filters, hashing."""
